"""Matching, timing, audio plan, subtitle choice and requests on hand-made rows. Expected values must be these for right results."""

import pytest
from pyspark.sql import functions as F

from cuelake.functions import rules, text
from cuelake.operators import align, catalog, lexicon, media

ENTRIES = [
    ("darn", "mild", ["darn", "darnin'", "darning"], False, True), ("dumbgit", "strong", ["dumb-git"], False, True), ("git", "mild", ["git"], False, True),
    ("god", "religious", ["god"], False, True), ("god darn", "religious", ["god darn"], True, True), ("off", "mild", ["off"], False, False),
    ("kick back", "mild", ["kick back"], True, True), ("kickback", "strong", ["kick-back"], False, True),
]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("dumbgit DUMB-GIT dumb'git dumb git", [("dumbgit", "dumbgit"), ("dumbgit", "DUMB-GIT"), ("dumbgit", "dumb'git"), ("git", "git")]),
        ("he was darnin’ tired", [("darn", "darnin’")]), ("darning DaRn", [("darn", "darning"), ("darn", "DaRn")]),
        ("oh my god\ndarn that", [("god", "god"), ("darn", "darn")]), ("God  darn it", [("god darn", "God  darn")]), ("god-darn god darn", [("god darn", "god-darn"), ("god darn", "god darn")]),
        ("god          darn", [("god", "god"), ("darn", "darn")]), ("for God's sake", [("god", "God")]), ("off", []), ("xdarn darnx darn_", []),
        ("kick back", [("kick back", "kick back")]), ("kickback", [("kickback", "kickback")]), ("kick-back", [("kick back", "kick-back")]),
    ],
)
def test_matches(spark, said, want):
    rows = spark.createDataFrame([(said, "k", "o")], "text string, key string, _owner string")
    found = lexicon.match_lexicon(rows, "text", ENTRIES).orderBy("char_start").collect()
    assert [(r.canonical, r.word_raw) for r in found] == want
    assert all(said[r.char_start : r.char_end] == r.word_raw and r.key == "k" for r in found)
    assert lexicon.redact(rows, "text", ENTRIES).first().n_hits == len(want)


def test_no_words_no_hits(spark):
    rows = spark.createDataFrame([("darn",), (None,)], "text string")
    assert lexicon.match_lexicon(rows, "text", [ENTRIES[5]]).count() == 0 and lexicon.match_lexicon(rows, "text", []).count() == 0
    assert sorted(map(tuple, lexicon.redact(rows, "text", ENTRIES).collect()), key=repr) == [("darn", "****", 1), (None, None, 0)]
    with pytest.raises(ValueError):
        lexicon.form_pattern("-'", False)


def timed(spark, said, targets=("shoot", "shooting"), offset=0, never=("shout",), cue=(10_000, 12_000), expected=11_000.0):
    words = spark.createDataFrame([(1, i, w, a, b) for i, (w, a, b) in enumerate(said)], "item_id int, word_index int, raw string, start_ms long, end_ms long")
    words = words.withColumn("core", text.strip_wrappers(F.col("raw"))).withColumn("word", text.fold(F.col("core")))
    hits = spark.createDataFrame([(k, 1, *cue, expected, list(targets)) for k in (1,)], "hit_id int, item_id int, start_ms long, end_ms long, expected_ms double, targets array<string>")
    found = align.pick_timing(hits, words, never=never, offset=offset).collect()
    return [(r.word_index, r.kind, r.confidence) for r in found]


def test_timing(spark):
    assert timed(spark, [("You", 10_000, 10_300), ("shooting,", 10_400, 10_900)]) == [(1, "exact", 0.95)]
    assert timed(spark, [("Oh", 10_000, 10_300), ("truck", 10_300, 10_800)]) == []
    assert timed(spark, [("shout", 10_300, 10_800)]) == []
    assert timed(spark, [("shout", 10_300, 10_800)], never=(), targets=("shouts",)) == [(0, "fuzzy", 0.818)]
    assert timed(spark, [("shots", 10_100, 10_400), ("shoot", 10_500, 10_900)]) == [(1, "exact", 0.95)]
    assert timed(spark, [("shoot", 20_000, 20_400)]) == []
    assert timed(spark, [("What", 10_000, 10_200), ("s****", 10_500, 11_000)]) == [(1, "censored", 0.8)]
    assert timed(spark, [("r****", 10_500, 11_000), ("***", 10_500, 11_000), ("!!", 10_500, 11_000)]) == []
    assert timed(spark, [("sh**t", 10_500, 10_600), ("shoot", 11_900, 12_000)]) == [(1, "exact", 0.95)]
    # The nearer of two equal words; the clock of the cues five seconds behind.
    assert timed(spark, [("shoot", 10_100, 10_200), ("shoot", 11_000, 11_200)]) == [(1, "exact", 0.95)]
    assert timed(spark, [("shoot", 16_000, 16_200), ("shoot", 11_000, 11_200)], offset=5_000) == [(0, "exact", 0.95)]


PLANS = [
    (("eac3", 6, 768_000, "Dolby Digital Plus + Dolby Atmos", False, None), ("eac3", 768_000, None, "eac3_passthrough")),
    (("dts", 6, 1_500_000, None, False, None), ("flac", None, "s16", "lossless_source")), (("opus", 8, 640_000, None, False, None), ("flac", None, "s16", "channels_gt_6")),
    (("TrueHD", 6, None, "Dolby TrueHD + Dolby Atmos", False, 24), ("flac", None, "s32", "truehd_atmos")), (("truehd", 6, None, None, False, 16), ("flac", None, "s16", "lossless_source")),
    (("aac", 2, 31_999, None, False, None), ("aac", 160_000, None, "aac_passthrough")), (("aac", 2, 8_000_001, None, False, None), ("aac", 160_000, None, "aac_passthrough")),
    (("aac", 6, 2_000_000, None, False, None), ("aac", 768_000, None, "aac_passthrough")), (("ac3", 6, 384_000, None, False, None), ("ac3", 640_000, None, "ac3_passthrough")),
    (("ac3", 2, 448_000, None, False, None), ("ac3", 448_000, None, "ac3_passthrough")), (("ac3", 2, None, None, False, None), ("ac3", 192_000, None, "ac3_passthrough")),
    (("eac3", 2, None, None, False, None), ("eac3", 224_000, None, "eac3_passthrough")), (("eac3", 6, 2_000_000, None, False, None), ("eac3", 1_024_000, None, "eac3_passthrough")),
    (("mp3", 2, 128_000, None, False, None), ("aac", 160_000, None, "lossy_fallback_aac")), ((None, None, None, None, False, None), ("aac", 160_000, None, "unknown_codec_fallback")),
    (("mp3", 2, 128_000, None, True, 24), ("flac", None, "s32", "forced_lossless")),
]


def test_audio_plan(spark):
    rows = spark.createDataFrame([(i, *p[0]) for i, p in enumerate(PLANS)], "i int, codec string, ch int, rate long, profile string, forced boolean, depth int")
    plan = rules.audio_plan(F.col("codec"), F.col("profile"), F.col("ch"), F.col("rate"), F.col("forced"), F.col("depth"))
    assert [tuple(r.p) for r in rows.orderBy("i").select(plan.alias("p")).collect()] == [p[1] for p in PLANS]


def test_choose_subtitle(spark):
    tracks = [
        (1, 0, False, "eng", True, False), (1, 1, False, "en-GB", False, False), (1, 2, False, "fra", False, False), (1, 3, False, None, True, False), (1, 4, False, "eng", False, True), (1, 5, False, "fra", False, True),
        (1, 6, True, "fre", False, False), (1, 7, True, None, False, False), (1, 8, True, "en", False, False), (1, 9, False, "en", True, True),
        (2, 0, True, None, False, False), (2, 1, True, "fra", False, False), (3, 0, True, "fra", False, False),
    ]
    df = spark.createDataFrame(tracks, "item_id int, track int, sidecar boolean, lang string, forced boolean, image boolean")
    got = {}
    for r in media.choose_subtitle(df, "eng").orderBy("item_id", "place").collect():
        got.setdefault(r.item_id, []).append((r.track, r.reason))
    assert [t for t, _ in got[1]] == [8, 1, 0, 2, 3, 4, 9, 5] and got[1][0][1] == "sidecar_preferred_language" and got[1][-1][1] == "ocr_any"
    assert got[2] == [(0, "sidecar_untagged")] and 3 not in got
    assert {r.track for r in media.choose_subtitle(df, "eng", ocr=False).where("item_id = 1").collect()} == {8, 1, 0, 2, 3}


def test_dedupe_requests(spark):
    asked = [
        (1, 1, 100, False), (2, 1, 130, False), (3, 1, 161, False), (4, 1, 200, True), (5, 1, 250, False),
        (6, 2, 100, False), (7, 2, 101, True), (8, 3, 100, False), (9, 3, 170, False), (10, 4, 100, None), (11, 5, 100, True),
    ]
    runs = [(2, "rendering", 90), (2, "done", 95), (3, "queued", 50), (4, "done", 90), (4, "cancelled", 99)]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    out = catalog.dedupe_requests(at(spark.createDataFrame(asked, "request_id int, item_id int, at long, supersede boolean"), "at"), at(spark.createDataFrame(runs, "item_id int, state string, created long"), "created"))
    assert {r.request_id: r.reason for r in out.collect()} == {
        1: "created", 2: "deduped", 3: "already_active", 4: "superseded", 5: "deduped", 6: "already_active", 7: "superseded", 8: "deduped", 9: "already_active", 10: "created", 11: "created",
    }
