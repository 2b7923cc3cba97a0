"""Source divergence against a plain version, on hand-made and hypothesis rows."""

import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm.divergence import iceberg_terms, source_divergence, term_table

SCHEMA = "lang string, source string, text string"


def plain(rows, least=3, top=200):
    rows = [(x or "", y or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))) for x, y, t in rows]
    seen = defaultdict(Counter)
    for lang, _, terms in rows:
        seen[lang].update(set(terms))
    kept = {lang: {t for t, n in seen[lang].items() if n >= least} for lang in seen}
    counts = {(x, y): Counter() for x, y, _ in rows}
    for lang, source, terms in rows:
        counts[lang, source].update(t for t in terms if t in kept[lang])
    out = []
    for (lang, source), mine in counts.items():
        keep = kept[lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(keep)) for t in keep}
        p, f = share(mine), lambda a, b: (a - b) ** 2 // b
        whole = share(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        pairs = {y: sum(f(p[t], q[t]) for t in keep) for (x, y), c in counts.items() if x == lang and y != source for q in [share(c)]}
        terms = {t: f(p[t], whole[t]) for t in keep if mine[t] and p[t] > whole[t]}
        for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def got(spark, rows, **more):
    return sorted(tuple(r) for r in source_divergence(spark.createDataFrame(rows, SCHEMA), **more).collect())


def test_odd_rows(spark):
    long = "été" * 40_000
    rows = [
        ("en", "a", "The the CAT"), ("en", "a", "The the CAT"), ("en", "b", "the cat dog-dog"), ("en", None, "cat 123 Dog"), ("en", "b", None), ("en", "z", ""),
        (None, "a", "x"), ("", "b", "x x"), (None, None, "X"), ("fr", "a", long), ("fr", "b", long + " " + long[:-3]), ("fr", "c", long + "s " + long), ("de", "one", "nur"),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, least=1, top=2) == plain(rows, 1, 2)
    assert got(spark, []) == []
    odd = spark.createDataFrame([(r[0], r[1], r[2], 7, "p") for r in rows], SCHEMA.replace("text", "`a.b`") + ", n int, term string")
    assert sorted(tuple(r) for r in source_divergence(odd, text_col="a.b").collect()) == plain(rows)


WORD = st.text("abé", min_size=1, max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["en", "fr"]), st.sampled_from(["s", "t", "u"]), st.lists(WORD, max_size=12).map(" ".join)), max_size=15))
def test_prefixes_are_counted_by_distinct_documents(spark, rows):
    kept = defaultdict(set)
    for k, (lang, _, text) in enumerate(rows):
        for t in text.split():
            kept[lang, t].add(k)
    want = {k for k, v in kept.items() if len(v) >= 2}
    table = term_table(spark.createDataFrame(rows, SCHEMA), first=1, size=64)
    assert {tuple(r) for r in iceberg_terms(table, 2, first=1).select("lang", F.col("term").cast("string")).collect()} == want


def test_small_slices(spark, monkeypatch):
    from cuelake.llm import divergence

    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = [("en", f"s{k % 4}", f"alpha beta{k % 3} gamma{k % 5} " * (k % 3 + 1)) for k in range(40)]
    assert got(spark, rows) == plain(rows)
