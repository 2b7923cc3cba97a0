"""Paths of the operators that small tables don't reach by themselves: split buckets, many rules, hot anchors, clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import embedding_dedup, packing, suffix_dedup, url_filter

from . import brute


def test_vectors_in_split_buckets(spark):
    """Buckets of many blocks, labels that are texts, repeated ids, and columns named like the operator's own."""
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.04) for x in base[i % 3]], "ab"[i % 2]) for i in range(240)] + [(500 + i, base[0], "a") for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({c: F.lit(1) for c in ("rep", "class", "copies", "mark", "n", "id")})
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(df, block=8).select("id", "n_links", "component_id").collect())
    assert got == sorted(brute.vectors(stored, 0.98), key=repr) or got == sorted(brute.vectors(stored, 0.98))


def test_links_leave_as_counts_and_forests():
    rng = np.random.default_rng(0)
    n = 400
    i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
    root = embedding_dedup._roots(n, i, j)
    want = brute.components(list(range(n)), zip(i.tolist(), j.tolist()))
    assert [want[k] for k in range(n)] == root.tolist()


def test_many_url_rules(spark):
    """Thousands of rules: only those filed under a token of the URL run, and the longest fitting one decides."""
    rules = [(f"h{i}.com", "/a/" if i % 2 else "/", "block") for i in range(3000)] + [("com", "/a/", "allow"), ("h7.com", "/a/x", "allow")]
    urls = [f"http://{'www.' if i % 3 else ''}h{i * 7}.com/{'a/x' if i % 5 else 'b'}/y" for i in range(200)] + [None, "", "http://h7.com", "http://com/a/"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n_candidates int")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules, []).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), k, h + p, v) for k, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = (max(fit)[2], max(fit)[3]) if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want)
        assert got[i].n_candidates <= 3


@pytest.mark.parametrize("crowd", [8192, 1])
def test_hot_anchors(spark, crowd, monkeypatch):
    """One line in most texts, some of them equal around it: its rows are counted in shares, with the same result."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60))
    noise = lambda k: "".join(rng.choice("xyz") for _ in range(k))
    rows = [(i, noise(rng.randrange(20)) + line + (noise(rng.randrange(20)) if i % 3 else "")) for i in range(120)] + [(200 + i, line + "same tail") for i in range(20)] + [(300, None), (300, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    used = []

    def hot(texts, min_bytes):
        keys = texts.mapInArrow(lambda b: suffix_dedup._anchors(b, min_bytes), suffix_dedup._ANCHORS)
        used.extend(r.key for r in keys.groupBy("key").count().where("count > 20").collect())
        return used

    monkeypatch.setattr(suffix_dedup, "_hot_keys", hot)
    found = suffix_dedup.find_repeats(df, min_bytes=40, crowd=crowd)
    out = found.table.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_cl_spans").alias("spans"))
    got = sorted((tuple(r) for r in out.mapInArrow(suffix_dedup._kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()), key=repr)
    found.close()
    assert used and got == brute.repeats(rows, 40)


def test_pack_keeps_clashing_columns(spark):
    rows = [(i, 0, 1 + i * 37 % 90, i * 7, f"r{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, piece int, length int, share int, rank string")
    got = packing.pack(df, capacity=100).collect()
    assert sorted((r.id, r.share, r.rank) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(places) == brute.best_fit([r[2] for r in rows], 100)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
