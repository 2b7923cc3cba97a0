"""Chains, claims in rounds, batches, silenced events and large word lists against steps one after another."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.operators import chains, intervals, large_lexicon, lexicon, scoring
from cuelake.streaming import events
from test_rules_of_record import ENTRIES

LEXICON = "canonical string, category string, forms array<string>, is_phrase boolean, enabled boolean"


def test_places_in_order_and_what_the_first_leads_to(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = chains.numbered(df, ["k"], [F.col("v")]).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.idx, r.v) for r in got if r.k == key)
        assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)
    links = {"a": {0: 3, 1: 2, 3: 4, 4: 9, 9: None}, "b": {0: None}, "c": {i: i + 1 if i < 12 else None for i in range(13)}}
    table = spark.createDataFrame([(k, i, n) for k, x in links.items() for i, n in x.items()], "k string, idx long, next long")
    reach = chains.reached(table, ["k"]).collect()
    assert sorted((r.k, r.idx) for r in reach) == [*[("a", i) for i in (0, 3, 4, 9)], ("b", 0), *[("c", i) for i in range(13)]]


def test_claims_where_all_want_the_same(spark):
    # Every side wants the same ones in the same order, and one item has most of the rows.
    rows = [(1, a, b, b) for a in range(12) for b in range(9)] + [(2, a, 5 - a, 0) for a in range(3)]
    out = scoring.claim_pairs(spark.createDataFrame(rows, "item_id int, l int, r int, away int"), "l", "r", ["away", "r"])
    assert sorted(tuple(r)[:3] for r in out.collect()) == [*[(1, a, a) for a in range(9)], (2, 0, 5), (2, 1, 4), (2, 2, 3)]
    assert scoring.claim_pairs(spark.createDataFrame([], "item_id int, l int, r int, away int"), "l", "r", ["away"]).count() == 0


def test_similarity_in_batches(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé中") for _ in range(rng.choice([0, 1, 3, 5, 8, 63, 64, 65, 90])))
    rows = [(word(), [word() for _ in range(rng.randrange(3))]) for _ in range(80)] + [(None, ["a"]), ("a", [None]), ("a", ["b", "a"]), ("a", None)]
    for k in range(10):
        w = word()
        rows.append((w, [w + "d", w[1:]]))
    df = spark.createDataFrame(rows, "w string, t array<string>")
    plain = F.array_max(F.transform("t", lambda t: text.similarity(F.col("w"), t)))
    for least in (0.0, 40.0, 85.0):
        got = df.select(text.best_similarity(F.col("w"), F.col("t"), least).alias("a"), F.when(plain >= least, plain).alias("b")).collect()
        assert [r.a for r in got] == pytest.approx([r.b for r in got])


def batches(rows, span, n):
    out, item, number, first, count = [], None, -1, 0.0, 0
    last = lambda x: (x is None, x or 0)
    for at, start, end in sorted(rows, key=lambda r: (r[0], last(r[1]), last(r[2]))):
        if at != item:
            item, number = at, -1
        if number < 0 or count >= n or (end is not None and first is not None and end - first > span):
            number, first, count = number + 1, start, 0
        count += 1
        out.append((at, start, end, number))
    return sorted(out, key=repr)


def test_batches(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2]), *rng.choice([(float(s), s + rng.choice([1.0, 2.0, 30.0])) for s in [rng.randrange(400)]] + [(None, 3.0), (5.0, None)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "item_id int, start double, end double")
    for span, n in ((10, 3), (25, 8)):
        assert sorted((tuple(r) for r in intervals.batch_segments(df, span, n).collect()), key=repr) == batches(rows, span, n)
    assert intervals.batch_segments(df.where("false")).count() == 0


def test_silenced_events(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, None]), rng.choice(["a", None]), rng.randrange(900) * 1_000_000) for i in range(250)]
    last, want = {}, set()
    for i, item, kind, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if (item, kind) not in last or at - last[item, kind] > 20_000_000:
            last[item, kind] = at
            want.add(i)
    got = events.dedupe_events(spark.createDataFrame(rows, "event_id long, item_id long, event_type string, at_us long"), 20)
    assert {r.event_id for r in got.collect()} == want


SAID = [
    "dumbgit DUMB-GIT dumb'git dumb git", "he was darnin’ tired, darnin'", "darning DaRn", "oh my god\ndarn that", "God  darn it", "god-darn god darn god    darn", "for God's sake", "off xdarn darnx darn_",
    "kick back kickback kick-back kick' -back", "GOD DARNING god darn", "", None, "...", "god darn god darn god darn", "a$$ x$$hit b a$$! $$hit", "ba$$ éa$$é", "one two three one two one two three four", "c++ c+ c++x",
]
MORE = [("a$$", "strong", ["a$$", "$$hit"], False, True), ("c++", "mild", ["c++"], False, True), ("one two", "mild", ["one two", "two three"], True, True), ("chain", "mild", ["three one", "one two three four", "two one"], True, True)]


def test_a_table_of_words_finds_what_the_expression_finds(spark):
    rows = spark.createDataFrame(list(enumerate(SAID)), "row int, text string")
    entries = ENTRIES + MORE
    want = lexicon.match_lexicon(rows, "text", entries).select("row", "char_start", "char_end", "word_raw", "canonical", "category")
    got = large_lexicon.match_table(rows, "text", spark.createDataFrame(entries, LEXICON), ["row"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert large_lexicon.match_table(rows, "text", spark.createDataFrame([], LEXICON), ["row"]).count() == 0
    with pytest.raises(Exception, match="without letters"):
        large_lexicon.match_table(rows, "text", spark.createDataFrame([("x", "y", ["$$"], False, True)], LEXICON), ["row"])


def test_a_hundred_thousand_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    small = [("of the", "religious", ["of the"], True, True), ("rewh", "strong", ["rewh", "orre"], False, True), ("of", "mild", ["of"], False, True)]
    many = spark.range(100_000).select(F.concat(F.lit("zq"), F.col("id")).alias("canonical"), F.lit("mild").alias("category"), F.array(F.concat(F.lit("zq"), F.col("id"))).alias("forms"), F.lit(False).alias("is_phrase"), F.lit(True).alias("enabled"))
    got = large_lexicon.match_table(docs, "text", many.union(spark.createDataFrame(small, LEXICON)), ["doc_id"])
    want = lexicon.match_lexicon(docs, "text", small).select("doc_id", "char_start", "char_end", "word_raw", "canonical", "category")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_keys_of_the_list_become_strings(spark):
    text = "of\0THE end, Of the ENDİ; of  thE end-of of the end"
    rows = spark.createDataFrame([(1, text), (2, "the of"), (3, text.replace("\0", " ")), (4, None), (5, "")], "row long, text string")
    lists = spark.createDataFrame([("of the", "x", ["of the", "of the end"], True, True), ("endi", "x", ["endi"], False, True)], LEXICON)
    forms = large_lexicon.form_table(lists)
    got = large_lexicon.candidates(rows, "text", forms, ["row"])
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r.row, r.char_start, r.word_raw) for r in got.collect())
    assert [(s, w) for r, s, w in found if r == 3] == [(0, "of THE"), (0, "of THE end"), (12, "Of the"), (19, "ENDİ"), (25, "of  thE"), (25, "of  thE end"), (40, "of the"), (40, "of the end")]
    assert [(s, w) for r, s, w in found if r == 1] == [(12, "Of the"), (19, "ENDİ"), (25, "of  thE"), (25, "of  thE end"), (40, "of the"), (40, "of the end")]
    assert {r for r, _, _ in found} == {1, 3}
