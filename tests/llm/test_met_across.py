"""Groups of a token's list that meet block by block, against the conditions as SQL and every pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import ngram_jaccard as nj


def _set(rng, size: int) -> set:
    return {rng.getrandbits(63) for _ in range(size)}


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize("num,den", [(8, 10), (4, 10)])
def test_blocks_let_through_what_the_conditions_do(spark, monkeypatch, block, num, den):
    monkeypatch.setattr(nj, "BLOCK", block)
    rng, sets, rows = random.Random(3), [], []
    for size in (40, 500, 530, 700, 1100, 2600):
        base = list(_set(rng, size))
        sets += [{*base[rng.randrange(size // 8) :], *_set(rng, rng.randrange(size // 8))} for _ in range(12)]
    # Three lists: one component has most of the first, another all of the second; groups that are no set's own have no field.
    for token, members in ((1, range(72)), (2, range(12)), (-3, range(1, 72, 2))):
        rows += [(token, 100 + g, len(sets[g]), rng.randrange(6), 7 if token == 2 or g % 12 < 7 else 100 + g) for g in members]
    lists = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    (told,) = nj._wide_fields(iter([pa.record_batch([pa.array(range(100, 172), pa.int64()), lists], names=["gid", "grams"])]))
    import numpy as np

    bits = [nj._bits(np.array(sorted(s), np.uint64)).tolist() if len(s) > nj.LARGE else None for s in sets]
    fields = [(g, v, w, bits[g - 100]) for g, v, w in zip(*(told.column(c).to_pylist() for c in ("gid", "wide", "weight"))) if g % 11]
    fields = spark.createDataFrame(fields, "gid long, wide array<long>, weight int, field array<long>")
    placed = spark.createDataFrame(rows, "token long, gid long, n int, pos int, part long")
    dealt = nj._dealt(placed).join(fields, "gid", "left").select("token", "low", "high", "block", "gid", "n", "pos", "part", "wide", "weight", "field")
    found = dealt.repartition(3, "token", "low", "high").sortWithinPartitions("token", "low", "high")
    got = {(r.token, r.gx, r.gy) for r in found.mapInArrow(lambda b: ((x.append_column("token", pa.array([0] * len(x), pa.int64()))) for x in nj._met_across(b, num, den)), "gx long, gy long, token long").collect()}
    full = placed.join(fields, "gid", "left")
    side = lambda s: full.select("token", *[F.col(c).alias(to + s) for c, to in {"gid": "g", "n": "n", "pos": "p", "part": "b", "wide": "v", "weight": "w", "field": "f"}.items()])
    fit = side("x").join(side("y"), "token").where(f"gx < gy and bx != by and {nj._fits(num, den)} and {nj._wide_fit(num, den)}").collect()

    def bound(a: list, b: list, n: int, both: int) -> bool:
        return sum((p & ~q & (1 << 64) - 1).bit_count() for p, q in zip(a, b)) * (num + den) <= n * (num + den) - num * both

    def fields_fit(r) -> bool:
        x, y = r.fx, r.fy
        if x is None or y is None:
            return True
        half = lambda a, b: [p | q for p, q in zip(a[: len(a) // 2], a[len(a) // 2 :])] if len(a) > len(b) else a
        x, y = half(x, y), half(y, x)
        return len(x) != len(y) or bound(x, y, r.nx, r.nx + r.ny) and bound(y, x, r.ny, r.nx + r.ny)

    want = {(0, r.gx, r.gy) for r in fit if fields_fit(r)}
    assert got == want and len(want) > 50
    # A component doesn't meet itself, and a list of one component goes nowhere.
    assert not dealt.where("token = 2").count()
    if block == 1024:
        assert dealt.count() == 72 + 36


def test_the_driver_gets_short_plans(spark, tmp_path):
    """Every step of a plan is printed, compiled and kept by the driver; comparisons that were spelt out there took most of its memory."""
    listened = []
    keep = nj.materialise

    def noted(df, name):
        listened.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("bit_count")))
        return keep(df, name)

    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.random()}" if j in cut else w for j, w in enumerate(base)) for i in range(40) for cut in [set(rng.sample(range(60), i % 4))]]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(nj, "materialise", noted)
        nj.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert max(n for _, n in listened) < 20, max(listened, key=lambda x: x[1])
