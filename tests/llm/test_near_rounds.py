"""Links between components that are many come out and go through the rounds as few."""

import random

import numpy as np
import pyarrow as pa

from cuelake.llm import common
from cuelake.llm import ngram_jaccard as nj


def _block(sets: list[set], parts: list[int]) -> pa.RecordBatch:
    lists = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    (told,) = nj._wide_fields(iter([pa.record_batch([pa.array(range(len(sets)), pa.int64()), lists], names=["gid", "grams"])]))
    same = {k: [v] * len(sets) for k, v in {"token": 1, "low": 0, "high": 0, "block": 0, "pos": 0}.items()}
    rows = same | {"gid": range(len(sets)), "n": [len(s) for s in sets], "part": parts, "wide": told.column("wide"), "weight": told.column("weight")}
    return pa.record_batch([*(v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in rows.values()), pa.nulls(len(sets), pa.list_(pa.int64()))], names=[*rows, "field"])


def test_few_pairs_of_two_components():
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(200)]
    # Two components of 40 sets each and one set alone; the set of gid 50 is most like those of the other component.
    sets = [{*base[: 200 - (0 if i in (0, 50) else 1 + i % 9)], *(rng.getrandbits(63) for _ in range(0 if i in (0, 50) else 1 + i % 9))} for i in range(81)]
    batch = _block(sets, [0] * 40 + [40] * 40 + [80])
    pairs = lambda few: [tuple(r.values()) for b in nj._met_across(iter([batch]), 8, 10, few) for r in b.to_pylist()]
    every, one, most = pairs(None), pairs(1), pairs(5000)
    assert len(every) == 40 * 40 + 80 and {p[:2] for p in most} == set(every) and not any(p[2] for p in most)
    assert len(one) == 3 and all(p[2] for p in one) and set(p[:2] for p in one) <= set(every)
    assert (0, 50, True) in one


def test_stars_need_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "materialise", lambda df, name, f=common.materialise: made.append(name) or f(df, name))
    stars = spark.createDataFrame([(9, 1), (1, 5), (7, 2), (2, 3), (4, 4)], "a long, b long")
    want = {1: 1, 5: 1, 9: 1, 2: 2, 3: 2, 7: 2}
    assert {r.id: r.component for r in common.connected_components(stars).collect()} == want and made == ["cc"]
    made.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (51, 52), (None, 3)], "a long, b long")
    got = [(r.id, r.component) for r in common.connected_components(chain).collect()]
    assert sorted(got) == [(i, 0) for i in range(41)] + [(50, 50), (51, 50), (52, 50)] and len(made) > 1
    assert not common.connected_components(stars.where("a > 99")).count()


def test_no_known_edge_goes_through_the_rounds_again(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.random()}" if j in cut else w for j, w in enumerate(base)) for i in range(160) for cut in [set(rng.sample(range(60), i % 4))]]
    calls = []

    def noted(edges, a="a", b="b"):
        calls.append({(min(r), max(r)) for r in edges.select(a, b).collect() if r[0] != r[1]})
        return common.connected_components(edges, a, b)

    monkeypatch.setattr(nj, "connected_components", noted)
    out = {r.id: r.component_id for r in nj.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    top = np.arange(160)
    for a in range(160):
        for b in range(a):
            if 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]) and top[a] != top[b]:
                top[top == max(top[a], top[b])] = min(top[a], top[b])
    assert out == dict(enumerate(top.tolist()))
    assert len(calls) > 1
    top = np.arange(160)
    for n, call in enumerate(calls):
        assert n == 0 or not any(top[a] == top[b] for a, b in call)
        for a, b in call:
            top[top == max(top[a], top[b])] = min(top[a], top[b])
