"""Groups of near copies just under the threshold: told apart within the join, and no link lost by it."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuelake.llm import ngram_jaccard as nj


def _copies(n: int) -> list[set]:
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(146)]
    return [{*(base[: 146 - k] if i % 2 else base[k:]), *(rng.getrandbits(63) for _ in range(k))} for i in range(n) for k in [i % 24]]


def test_wide_fields_lose_no_link_and_part_most_others(spark):
    sets = _copies(96) + [set(), {7}, set(random.Random(6).sample(range(1 << 62), 3000))]
    lists = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    (told,) = nj._wide_fields(iter([pa.record_batch([pa.array(range(len(sets)), pa.int64()), lists], names=["gid", "grams"])]))
    assert told.column("weight").to_pylist() == [int(np.bitwise_count(np.array(w, np.int64).view(np.uint64)).sum()) for w in told.column("wide").to_pylist()]
    rows = spark.createDataFrame([(g, w, k, len(sets[g])) for g, w, k in zip(*(told.column(c).to_pylist() for c in ("gid", "wide", "weight")))], "g long, v array<long>, w int, n int")
    side = lambda s: rows.select(*[F.col(c).alias(c + s) for c in ("g", "v", "w", "n")])
    got = {(r.gx, r.gy) for r in side("x").crossJoin(side("y")).where("gx < gy").where(nj._wide_fit(8, 10)).collect()}
    link = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert link and link <= got
    apart = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b]} - link
    assert len(got & apart) < len(apart) / 10
    unknown = rows.where("g < 2").withColumn("v", F.lit(None).cast("array<long>"))
    assert unknown.selectExpr("v vx", "v vy", "w wx", "w wy", "n nx", "n ny").where(nj._wide_fit(8, 10)).count() == 2


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.random()}" if j in cut else w for j, w in enumerate(base)) for i in range(80) for cut in [set(rng.sample(range(60), i % 4))]]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    top = list(range(80))

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for a in range(80):
        for b in range(a):
            if 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    out = nj.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.id: r.component_id for r in out.collect()} == {i: root(i) for i in range(80)}
