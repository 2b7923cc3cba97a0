"""Registered queries against their SQL, and goldens for what SQL doesn't express."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.operators import align, intervals, lexicon
from cuelake.plans.registry import ORACLE_SQL, QUERIES
from cuelake.sources import readers
from cuelake.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def value(x):
        if x is None or x != x:
            return None
        return int(x) if isinstance(x, float) and x == int(x) else round(x, 9) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([value(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(ORACLE_SQL[name]).df())


def test_sessions_equal_merged_ranges(spark):
    a = {tuple(r) for r in QUERIES["session_ranges"](spark, SF).select("item_id", "start", "end").collect()}
    assert a == {tuple(r) for r in QUERIES["merge_ranges"](spark, SF).select("item_id", "start", "end").collect()}


def test_stream_of_item_states_equals_batch(spark, tmp_path):
    from cuelake.plans import fixtures as fx

    rows = fx.catalog_events(spark, SF).select("event_id", "item_id", "event_type", "at_us")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.item_state_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").select("item_id", "renames", "n_events").collect()} == {tuple(r) for r in events.item_state(rows).select("item_id", "renames", "n_events").collect()}


def test_merge_is_transitive_and_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 23, 30), (1, 5, 5), (2, 0, 1)], "item_id long, start long, end long")
    assert sorted(map(tuple, intervals.merge_ranges(df, 2).collect())) == [(1, 0, 20), (1, 23, 30), (2, 0, 1)]


def test_similarity(spark):
    pairs = spark.createDataFrame([("abcd", "abcdefg"), ("abc", "abc"), ("", ""), ("a", ""), ("kitten", "sitting")], "a string, b string")
    got = [round(r[0], 1) for r in pairs.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [72.7, 100.0, 100.0, 0.0, 61.5]


def test_cues(spark):
    srt = "﻿1\r\n00:00:01,500 --> 00:00:03,000\r\n<i>Hello</i> there\r\n\r\n2\r\n00:00:04,000 --> 00:00:05,000\r\n\r\n\r\n3\r\n01:00:00,250 --> 01:00:01,000\r\n{\\an8}Bye\r\nnow\r\n"
    got = [tuple(r) for r in readers.parse_cues(spark.createDataFrame([("f", srt)], "path string, value string")).collect()]
    assert got == [("f", 0, 1500, 3000, "Hello there"), ("f", 2, 3600250, 3601000, "Bye now")]


def test_masked_words(spark):
    words = ["f***", "sh*t", "f-ing", "f--k", "hello", "***", "x-ray"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.detect_censored(F.col("w"), never_match=F.array(F.lit("xray"))).alias("c"))
    got = {r.w: r.c and (r.c.style, r.c.length, [(x.pos, x.letter) for x in r.c.revealed], r.c.suffix) for r in df.collect()}
    assert got["f***"] == ("masked", 4, [(0, "f")], "") and got["sh*t"] == ("masked", 4, [(0, "s"), (1, "h"), (3, "t")], "")
    assert got["f-ing"] == ("hyphen", 5, [(0, "f")], "ing") and got["f--k"] == ("masked", 4, [(0, "f"), (3, "k")], "")
    assert got["hello"] is None and got["***"] is None and got["x-ray"] is None


def test_matches_have_places_and_phrases(spark):
    entries = [("darn", "mild", ["darn", "darned"], False, True), ("good grief", "mild", ["good grief"], True, True), ("off", "mild", ["off"], False, False)]
    df = spark.createDataFrame([(1, "Darned! Good-grief, offdarn darn off")], "id long, text string")
    got = [tuple(r) for r in lexicon.match_lexicon(df, "text", entries).orderBy("char_start").select("char_start", "char_end", "word_raw", "canonical").collect()]
    assert got == [(0, 6, "Darned", "darn"), (8, 18, "Good-grief", "good grief"), (28, 32, "darn", "darn")]
    assert lexicon.match_lexicon(df, "text", []).count() == 0
    assert lexicon.redact(df, "text", entries).first().redacted == "******! ****-*****, offdarn **** off"


def test_each_word_is_claimed_once(spark):
    hits = spark.createDataFrame([(1, 7, 0, 2000, 1000.0, ["abc"]), (2, 7, 0, 2000, 1000.0, ["abc"]), (3, 8, 0, 2000, 0.0, ["zzz"])], "hit_id long, item_id long, start_ms long, end_ms long, expected_ms double, targets array<string>")
    words = spark.createDataFrame([(7, 0, "abc", 500, 800), (7, 1, "abc", 1000, 1300), (8, 0, "yyy", 0, 100)], "item_id long, word_index int, word string, start_ms long, end_ms long")
    assert sorted((r.hit_id, r.word_index) for r in align.pick_timing(hits, words).collect()) == [(1, 1), (2, 0)]


def test_batches(spark):
    df = spark.createDataFrame([(1, float(s), float(s + 10)) for s in (0, 100, 295, 300, 620)], "item_id long, start double, end double")
    assert [r.batch for r in intervals.batch_segments(df).orderBy("start").collect()] == [0, 0, 1, 1, 2]
