"""Tokens, redaction of marked lines, streams and settings on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.operators import align, catalog, lexicon, media
from cuelake.plans import fixtures as fx
from cuelake.plans.registry import QUERIES
from cuelake.streaming import events as ev

ENTRIES = [("darn", "mild", ["darn", "darning"], False, True), ("god darn", "religious", ["god darn"], True, True)]


def test_joined_tokens_and_spans(spark):
    said = ["...", "oh", "my", "God", "--", "!", "Darn", "it", "god", "darn", "?"]
    norms = [w.lower() if w[0].isalpha() else "" for w in said]
    words = spark.createDataFrame([(1, i, n) for i, n in enumerate(norms)] + [(2, 0, "")], "item_id int, word_index int, norm string")
    joined = lexicon.join_tokens(words)
    assert {r.item_id: r.joined for r in joined.collect()} == {1: "oh my god\ndarn it god darn", 2: ""}
    hits = lexicon.match_lexicon(joined.select("item_id", "joined"), "joined", ENTRIES).select("item_id", "canonical", "char_start", "char_end")
    assert sorted((r.canonical, r.first_word, r.last_word) for r in lexicon.span_to_tokens(hits, joined).collect()) == [("darn", 6, 6), ("god darn", 8, 9)]
    far = spark.createDataFrame([(1, 90, 95)], "item_id int, char_start int, char_end int")
    assert lexicon.span_to_tokens(far, joined).first()[3:] == (None, None)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("plain darn", ("plain ****", 1, 0)), ("d{\\i1}arn it", ("**** it", 1, 1)), ("{\\b1}darn{\\b0} d{\\i1}ar{\\i0}n", ("{\\b1}****{\\b0} ****", 2, 2)), ("x{\\i1}darn", ("x{\\i1}darn", 0, 0)),
        ("god\\hdarn", ("*** ****", 1, 0)), ("god\\Ndarn", ("god\\N****", 1, 0)), ("{\\i1}only marks{\\i0}", ("{\\i1}only marks{\\i0}", 0, 0)), ("", ("", 0, 0)), (None, (None, 0, 0)), ("{ open darn", ("{ open ****", 1, 0)),
    ],
)
def test_redacted_marks(spark, line, want):
    df = spark.createDataFrame([(1, line)], "id int, text string")
    assert tuple(lexicon.redact_markup(df, "text", ENTRIES).select("redacted", "n_hits", "tags_dropped").first()) == want


def test_redaction_leaves_what_rules_spare(spark):
    df = spark.createDataFrame([("darn it",), ("the CAFÉ darn",)], "text string")
    got = [r.redacted for r in lexicon.redact_markup(df, "text", ENTRIES, rules=[("darn", "café")]).collect()]
    assert got == ["**** it", "the CAFÉ darn"]
    assert lexicon.redact_markup(df, "text", ENTRIES, rules=[("darn", "")]).where("n_hits > 0").count() == 0


def test_token_spans_by_brute_force(spark, tmp_path):
    texts = ["Of the rewh, of. The orre!", "", None, "hehely of  the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["token_spans"](spark, str(tmp_path)).select("item_id", "canonical", "first_word", "last_word").collect())
    assert got == [(0, "of the", 0, 1), (0, "of the", 3, 4), (0, "rewh", 2, 2), (0, "rewh", 5, 5), (3, "hehely", 0, 0), (3, "of the", 1, 2)]


def test_merged_items(spark):
    fields = "item_id int, title_id int, kind string, season int, episode int, episode_title string, file_id int, path string, size long, status string, skip boolean, last_run_id int, cleaned_at timestamp, fingerprint string"
    items = spark.createDataFrame(
        [(1, 1, "episode", 1, 1, "A", 5, "/a", 10, "pending", True, None, None, None), (2, 1, "episode", 1, 2, None, 6, "/b", 20, "clean", False, 7, None, "f"), (3, 2, "movie", None, None, None, 9, "/m", 5, "clean", False, None, None, None),
         (4, 2, "movie", None, None, None, 9, "/m2", 5, "clean", False, None, None, None), (5, 9, "episode", 3, 3, None, 1, "/old", 1, "failed", True, None, None, None)], fields)
    files = spark.createDataFrame(
        [(1, "episode", 1, 1, None, "/b", 50, 99, True), (2, "movie", None, None, None, "/new", 51, None, False), (1, "episode", 3, 3, "T", "/old", 52, 1, True), (1, "episode", 4, 4, None, "/x", 53, 1, True)],
        "title_id int, kind string, season int, episode int, episode_title string, path string, file_id int, size long, defer boolean")
    resolved, merges = catalog.resolve_items(items, files)
    got = {r.file_id: r for r in resolved.collect()}
    assert {k: (r.item_id, r.outcome, r.status, r.skip, r.size, r.last_run_id, r.episode_title) for k, r in got.items()} == {
        50: (1, "merged", "clean", True, 99, 7, "A"), 51: (3, "updated", "clean", False, 5, None, None), 52: (5, "adopted", "failed", True, 1, None, "T"), 53: (None, "created", "untracked", True, 1, None, None),
    }
    assert [tuple(r) for r in merges.collect()] == [(2, 1)]
    children = spark.createDataFrame([(10, 2), (11, 5)], "run_id int, item_id int")
    assert sorted(map(tuple, catalog.repoint(children, merges).collect())) == [(10, 1), (11, 5)]


def test_ocr_cues(spark):
    cues = spark.createDataFrame([(1, 0, "a", 90.0), (1, 1, "", 99.0), (1, 2, "b", 59.9), (1, 3, "c", 60.0), (1, 4, None, 70.0), (2, 0, "x", 1.0)], "item_id int, cue_index int, text string, confidence double")
    kept, stats = media.ocr_filter(cues)
    assert sorted((r.item_id, r.cue_index, r.text) for r in kept.collect()) == [(1, 0, "a"), (1, 1, "c")]
    assert {r.item_id: tuple(r)[1:] for r in stats.collect()} == {1: (5, 2, 2, 1, 75.0), 2: (1, 0, 0, 1, 0.0)}


def test_settings_and_times(spark):
    df = spark.createDataFrame([('{"profile_hash": "x"}',), ("[1]",), ("{",), (None,), ("{}",)], "s string")
    assert [r[0] for r in df.select(text.snapshot_hash(F.col("s"))).collect()] == ["x", None, None, None, None]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' as t").select(F.unix_seconds(text.as_utc(F.col("t")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert at == 1577836800


def test_streams_equal_tables(spark, tmp_path):
    """Hits, item states, ranges, routes and stored events of a stream are those of the table."""
    d = "/root/testdata/sf0.001"
    events = fx.catalog_events(spark, d).select("event_id", "item_id", F.col("item_id").alias("title_id"), "event_type", "at_us", "ts", "props")
    for name, df in (("events", events), ("cues", fx.cues(spark, d))):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}")
    streamed = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/{name}")

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    entries = [e for e in fx.LEXICON if not e[3]]
    hits = ["item_id", "cue_index", "char_start", "canonical", "hit_start_ms"]
    assert rows(run(ev.match_stream(streamed("cues"), entries), "hits").select(*hits)) == rows(lexicon.find_hits(fx.cues(spark, d), entries).select(*hits))
    titles = events.select("title_id").where("title_id % 2 = 0")
    route = ["event_id", "action", "note"]
    assert rows(run(ev.route_events(streamed("events"), titles), "routes").select(*route)) == rows(ev.route_events(events, titles).select(*route))
    state = run(ev.item_state_stream(streamed("events").select("item_id", "event_type", "at_us")), "states", "update")
    last = state.groupBy("item_id").agg(F.max_by(F.struct("status", "unskipped", "disabled", "renames", "n_events"), "n_events").alias("s")).select("item_id", "s.*")
    assert rows(last) == rows(ev.item_state(events))
    ev.store_events(streamed("events"), f"{tmp_path}/stored", f"{tmp_path}/cp-stored").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/stored").select("event_id", "props")) == rows(events.select("event_id", "props"))
    seen = run(ev.dedupe_stream(streamed("events").select("item_id", "event_type", "ts")), "deduped")
    assert rows(seen.select("item_id", "event_type").distinct()) == rows(events.select("item_id", "event_type").distinct())


def test_located_phrases(spark):
    words = spark.createDataFrame([(1, i, w, a, a + 200) for i, (w, a) in enumerate([("oh", 10_000), ("god", 10_300), ("darn", 10_700), ("it", 11_000), ("son", 20_000), ("of", 20_300), ("gun", 30_900)])], "item_id int, word_index int, word string, start_ms long, end_ms long")
    hits = [(1, 1, 10_000, 12_000, 10_500.0, ["god darn"], "god darn", []), (2, 1, 20_000, 22_000, 20_500.0, ["son of a gun"], "son of a gun", []), (3, 1, 10_000, 12_000, 10_500.0, ["oh it"], "oh it", ["it"]), (4, 1, 10_000, 12_000, 10_500.0, ["no way"], "no way", [])]
    df = spark.createDataFrame(hits, "hit_id int, item_id int, start_ms long, end_ms long, expected_ms double, targets array<string>, said string, focus array<string>")
    got = {r.hit_id: (r.start_ms, r.end_ms, r.confidence, r.suspicious) for r in align.locate_phrases(df, words).collect()}
    assert got == {1: (10_300, 10_900, 0.95, False), 2: (20_000, 20_200, 0.95, True), 3: (11_000, 11_200, 0.95, False)}


def test_located_phrases_query(spark, tmp_path):
    spark.createDataFrame([(1, "x of the y"), (2, "of of the"), (3, "Of. The")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["located_phrases"](spark, str(tmp_path)).select("item_id", "hit_id", "start_ms", "end_ms", "suspicious").collect())
    assert got == [(1, 1, 400, 1100, False), (2, 1, 400, 1100, False), (3, 0, 0, 700, False)]


def test_profile_keys():
    entries = [("a", "mild", ["a", "aa"], False, True), ("b", "mild", ["b"], False, True), ("c", "mild", ["c"], False, False)]
    key = lexicon.profile_key(["x", "y"], ["q"], entries, ["n"])
    assert key == lexicon.profile_key(["y", "x", "x"], ["q"], entries[1::-1], ["n"]) != lexicon.profile_key(["x", "y"], ["q"], entries, ["n"], pads=(80, 121))
    assert key != lexicon.profile_key(["x", "y"], ["q"], [*entries[:2], (*entries[2][:4], True)], ["n"])
