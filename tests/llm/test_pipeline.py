"""The classifier's shrinkage and the whole chain of stages against plain versions on the smallest tables."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"


def shrunk(groups):
    """{(host, path): (n, s)} to {(host, path): (host rate, path rate, global rate)}, step by step."""

    def strength(mean, values):
        v = statistics.variance(values) if len(values) > 1 else 0
        return max(2.0, min(10_000.0, mean * (1 - mean) / v - 1)) if v else 10_000.0

    hosts = {}
    for (h, _), (n, s) in groups.items():
        a, b = hosts.get(h, (0, 0.0))
        hosts[h] = (a + n, b + s)
    top = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    k = strength(top, [s / n for n, s in hosts.values()])
    rate = {h: (s + k * top) / (n + k) for h, (n, s) in hosts.items()}
    spread = sum((s / n - rate[h]) ** 2 for (h, _), (n, s) in groups.items()) / len(groups)
    out = {}
    for (h, p), (n, s) in groups.items():
        k = max(2.0, min(10_000.0, rate[h] * (1 - rate[h]) / spread - 1)) if spread else 10_000.0
        out[h, p] = (rate[h], (s + k * rate[h]) / (n + k), top)
    return out


def test_shrinkage(spark):
    groups = {("a", "x"): (40, 31.0), ("a", "y"): (2, 0.1), ("b", "x"): (900, 12.5), (None, None): (3, 2.9), ("c", None): (1, 0.5), ("c", "z"): (70, 2.0)}
    df = spark.createDataFrame([(h, p, n, s) for (h, p), (n, s) in groups.items()], "host string, path string, n long, s double")
    got = {(r.host, r.path): (r.host_rate, r.path_rate, r.global_rate) for r in quality.site_rates(df).collect()}
    want = shrunk(groups)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-9)
    one = quality.site_rates(df.where("host = 'b'")).first()
    assert one.host_rate == pytest.approx(12.5 / 900) and one.path_rate == pytest.approx(12.5 / 900)


def plain_judgement(rows, heads):
    """{row number: rejected} of (text, source, lang) rows."""
    logits = {}
    for k, (text, source, lang) in enumerate(rows):
        styles, words = np.array([quality.style_of(text or "")]), [quality.words_of(text or "")]
        logits[k] = [float(h.logits(styles, words)[0]) for h in heads.values()]
    sig = lambda x: 1 / (1 + math.exp(-x))
    chance = {k: 0.0 for k in logits}
    for t in range(len(heads)):
        groups = {}
        for k, (_, source, lang) in enumerate(rows):
            key = (source, "/".join(x for x in (source, lang) if x is not None))
            n, s = groups.get(key, (0, 0.0))
            groups[key] = (n + 1, s + sig(logits[k][t]))
        rates = shrunk(groups)
        for k, (_, source, lang) in enumerate(rows):
            _, path, top = rates[source, "/".join(x for x in (source, lang) if x is not None)]
            chance[k] = max(chance[k], sig(logits[k][t] + math.log(path / (1 - path)) - math.log(top / (1 - top))))
    return chance


def test_op7_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    heads = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.TARGETS)
    chance = plain_judgement([r[1:] for r in rows], heads)
    got = {r.doc_id: (r.p_reject, r.kept) for r in quality.op7_quality(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        assert got[r.doc_id][0] == pytest.approx(chance[k], abs=2e-6) and got[r.doc_id][1] == (chance[k] < 0.5)


def test_toxic_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    heads = quality.fit(docs, labels.where("doc_id % 4 != 0"), quality.TARGETS)
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id")
    out = quality.judge(held, heads, F.col("source"), F.concat_ws("/", "source", "lang")).select("quality", "toxic", "kept").toPandas()
    toxic = (out.toxic == 1) & (out.quality == 1)
    assert toxic.sum() > 10 and out[toxic].kept.mean() < 0.1


def test_ties_repeats_and_names_in_the_classifier(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", True, 1.0), (1, "a b", "s", "en", False, 2.0), (None, None, None, None, None, None), (2, "", "s", None, True, 0.0)], "doc_id long, text string, source string, lang string, kept boolean, evidence double")
    heads = quality.fit(docs, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"), quality.TARGETS)
    out = quality.judge(docs, heads, F.col("source"), F.col("lang")).collect()
    assert len(out) == 4 and all(r.kept is not None for r in out) and len({r.p_reject for r in out if r.doc_id == 1}) == 1
    stage = quality.good_documents(spark, docs, SF)
    assert stage.columns == docs.columns and stage.schema == docs.schema and stage.count() <= 4


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    heads = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.TARGETS)
    chance = plain_judgement([r[1:] for r in rows], heads)
    rows = [(r[0], r[1]) for k, r in enumerate(rows) if chance[k] < 0.5]
    last = {}
    for doc, text in rows:
        last[text or ""] = max(last.get(text or "", doc), doc)
    rows = [(d, t) for d, t in rows if last[t or ""] == d]
    smallest = {doc: top for doc, _, top in brute.near(rows, 5, 8, 10)}
    rows = [(d, t) for d, t in rows if smallest[d] == d]
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for d, b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    kept = []
    for (d, b), (_, t) in zip(raw, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept.append((d, None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    want = brute.pieces(kept)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr) == want
    assert got.select("sequence_id").distinct().count() == brute.best_fit([w[3] for w in want])
    assert len(want) < docs.count()


def test_stages_of_odd_tables(spark):
    """Nulls, repeats, further columns and no rows, through every stage."""
    kinds = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, row int, part string"
    long = " ".join(f"w{i % 900}" for i in range(6000))
    rows = [(1, None, "en", "s", 0, True, 1, "p"), (1, "", None, None, None, None, None, None), (2, long, "en", "s", 1, False, 2, "q"), (2, long, "en", "s", 1, False, 2, "q"), (None, "x y z", "fr", "t", 3, None, 3, None), (3, long + " end", "en", "s", 1, True, 4, "r")]
    full = spark.createDataFrame(rows, kinds)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                want = brute.pieces([r[:2] for r in rows]) if docs is full else []
                assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == want
            else:
                assert out.columns == full.columns and out.schema == full.schema
                out.write.format("noop").mode("overwrite").save()
