"""Text queries over every row against plain versions, on texts in several languages and beyond ASCII."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.functions.text import WRAPPERS
from cuelake.operators import align, lexicon
from cuelake.plans import fixtures as fx
from cuelake.plans.registry import QUERIES

TEXTS = [
    ("en", "Rewh, the plain orre."), ("fr", "«REWH» déjà thatin rewhé ononﬅ"), ("de", "Straße THATIN of the — ononſt"), ("es", "¡inoran! th***n o--- h-hely o-st"),
    ("en", "naïve of the hehely"), ("en", None), ("en", ""), ("fr", "ＲＥＷＨ r@wh"), ("en", " ".join(["w"] * 470 + ["rewh"])),
]
SINGLE = {f: e[0] for e in fx.LEXICON if e[4] and not e[3] for f in e[2]}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame([(i, t, g, "s") for i, (g, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, (_, t) in enumerate(TEXTS)], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def hits():
    # Long s is the only letter of the texts that the matcher takes for another one.
    for i, (_, t) in enumerate(TEXTS):
        for w in re.findall(r"\w+", t or ""):
            if w.replace("ſ", "s").lower() in SINGLE:
                yield i, w.replace("ſ", "s").lower()


def words():
    return [(i, k, w.strip().strip(WRAPPERS).strip()) for i, (_, t) in enumerate(TEXTS) if t is not None for k, w in enumerate(re.split(r"\s+", t))]


def rows(spark, data, name):
    return sorted(map(tuple, QUERIES[name](spark, data).collect()), key=repr)


def test_hits_of_all_rows(spark, data):
    found = list(hits())
    assert len(found) > 6
    per = Counter((SINGLE[w], c) for _, w in found for c in {e[1] for e in fx.LEXICON if e[0] == SINGLE[w]})
    docs = {k: len({i for i, w in found if SINGLE[w] == k[0]}) for k in per}
    assert rows(spark, data, "match_word_counts") == sorted(((*k, n, docs[k]) for k, n in per.items()), key=repr)
    assert Counter(r[3] for r in rows(spark, data, "find_hits")) == {k[0]: n for k, n in per.items()}
    n_hits = Counter(i for i, _ in found)
    masked = lambda t: None if t is None else re.sub(r"\w+", lambda m: "*" * len(m[0]) if m[0].replace("ſ", "s").lower() in SINGLE else m[0], t)
    assert rows(spark, data, "redact") == [(i, n_hits[i], masked(t)) for i, (_, t) in enumerate(TEXTS)]
    assert rows(spark, data, "redaction_stats") == [("s", len(TEXTS), len(n_hits), len(found))]
    gate = rows(spark, data, "innocent_gate")
    assert {r[2] for r in gate if r[1] == "matches"} == {SINGLE[w] for _, w in found} and {r[0] for r in gate if r[1] == "censored"} == {"th***n", "o---", "o-st", "h-hely", "r@wh"}
    assert rows(spark, data, "phrase_documents") == [(2,)]


def test_words_of_all_rows(spark, data):
    fold = lambda w: re.sub("['-]", "", re.sub("[’ʼ‘]", "'", re.sub("[–—‑]", "-", unicodedata.normalize("NFKC", w).casefold())))
    assert rows(spark, data, "strip_wrappers") == sorted(Counter(w for _, _, w in words()).items(), key=repr)
    assert rows(spark, data, "fold_words") == sorted(Counter(fold(w) for _, _, w in words()).items(), key=repr)
    assert [r[:2] for r in rows(spark, data, "shifted_words")] == sorted(((i, k) for i, k, _ in words()), key=repr)
    assert {r[0] for r in rows(spark, data, "assign_to_segment")} == {i for i, _, _ in words()}
    spoken = [(i, 0, k, w) for i, (_, t) in enumerate(TEXTS) for k, w in enumerate(re.findall(r"[^\t-\r ]+", t or ""))]
    assert [r[:4] for r in rows(spark, data, "cue_word_spans")] == sorted(spoken, key=repr)


def test_candidates_of_all_styles(spark, data):
    want = []
    for i, k, w in words():
        low = w.lower()
        for f in SINGLE:
            if re.fullmatch(r"[A-Za-z]-{2,}[A-Za-z]*", w) or (re.fullmatch(r"[A-Za-z][A-Za-z*_#@$]{1,13}", w) and re.search(r"[*_#@$]", w)):
                if abs(len(f) - len(w)) <= 1 and all(not re.match("[a-z]", c) or f[p : p + 1] == c for p, c in enumerate(low)):
                    want.append((i, k, f))
            elif re.fullmatch(r"[A-Za-z]-[a-z]{1,6}", w) and f[0] == low[0] and f.endswith(w[2:]):
                want.append((i, k, f))
    assert len({w[:2] for w in want}) >= 4
    assert rows(spark, data, "censored_candidates") == sorted(want, key=repr)


def test_context_rules_fold_unicode(spark):
    found = spark.createDataFrame([(1, 1, 1, "darn", "ＣＡＦÉ straße"), (2, 1, 1, "darn", "cafe")], "hit_id long, item_id long, title_id long, canonical string, context string")
    table = spark.createDataFrame([("darn", "global", None, "café STRASSE", "suppress")], "canonical string, scope string, scope_id long, context_text string, mode string")
    assert {r.hit_id: r.whitelisted for r in lexicon.suppress(found, table).collect()} == {1: True, 2: False}


def test_segments_without_the_product(spark, data):
    """Gaps, overlaps, ties and far edges against the distance to every segment, and no join on the item alone."""
    rng = random.Random(3)
    said = [(i, k, t, t + 300) for i in range(3) for k, t in enumerate(sorted(rng.randrange(400_000) for _ in range(150)))] + [(9, 0, 5, 10)]
    segs = [(i, k, t, t + rng.choice([0, 500, 20_000, 90_000])) for i in range(3) for k, t in enumerate(rng.randrange(100_000, 300_000) for _ in range(6 + i))]
    segs += [(0, 50, 350_000, 350_100), (0, 51, 350_000, 350_100)]
    out = align.assign_to_segment(spark.createDataFrame(said, "item_id long, word_index int, start_ms long, end_ms long"), spark.createDataFrame(segs, "item_id long, seg_index int, start long, end long"))
    want = {}
    for i, k, a, b in said:
        mid = (a + b) / 2
        near = [(s0 - mid if mid < s0 else mid - s1 if mid > s1 else 0, n) for j, n, s0, s1 in segs if i == j]
        if near:
            want[i, k] = min(near)[1]
    assert {(r.item_id, r.word_index): r.seg_index for r in out.collect()} == want
    assert {r[0:2]: r[2] for r in rows(spark, data, "assign_to_segment")}[8, 470] == 9


def test_segments_of_a_long_text_are_linear(spark):
    """6,000 words and segments of one item: no join of the plan makes more than a few rows a word."""
    said = spark.range(6000).select(F.lit(1).alias("item_id"), F.col("id").alias("word_index"), (F.col("id") * 400).alias("start_ms"), (F.col("id") * 400 + 300).alias("end_ms"))
    segs = said.select("item_id", F.col("word_index").alias("seg_index"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    out = align.assign_to_segment(said, segs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("_b" in x for x in joins)
    assert out.where("word_index = seg_index").count() == 6000
