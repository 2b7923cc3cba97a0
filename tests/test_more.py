"""Goldens for operators whose queries have no SQL, and edge cases of the file checks."""

from cuelake.operators import align, lexicon, media, scoring


def test_masked_words_without_detection(spark):
    tokens = spark.createDataFrame([(1, 7, 0, 300), (2, 7, 1000, 1300), (3, 7, 5000, 5300), (4, 8, 0, 300)], "token_id int, item_id long, start_ms long, end_ms long")
    names = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a")], "token_id int, canonical string")
    found = spark.createDataFrame([(7, 300, 900), (7, 5200, 5400)], "item_id long, d0 long, d1 long")
    got = {r.token_id: r.canonical for r in align.standalone_censored(tokens, names, found).collect()}
    assert got == {1: "a", 2: "<censored>"}  # 1 only touches, 3 overlaps, 4 may stand for nothing


def test_transcript_phrases(spark):
    words = spark.createDataFrame([(1, i, w, i * 400, i * 400 + 300, p) for i, (w, p) in enumerate([("oh", 0.9), ("good", 0.5), ("grief", 0.7), ("good", 0.2)])], "item_id long, word_index int, norm string, start_ms long, end_ms long, probability double")
    forms = spark.createDataFrame([("good grief", "good grief", "mild"), ("oh", "oh", "mild")], "key string, canonical string, category string")
    found = spark.createDataFrame([(1, 0, 100)], "item_id long, d0 long, d1 long")
    got = [(r.word_index, r.n_words, r.start_ms, r.end_ms, round(r.confidence, 6)) for r in align.stt_only(words, forms, found, longest=2).collect()]
    assert got == [(1, 2, 400, 1100, 0.6)]


def test_probe_alignment(spark):
    word = "array<struct<word:string,start_ms:long>>"
    sub, stt = [("the", 0), ("old", 400), ("house", 800), ("up", 1200)], [("the", 100), ("cold", 500), ("house", 1000), ("up", 1300)]
    rows = spark.createDataFrame([(1, 0, sub, stt), (1, 1, sub, []), (1, 2, [], stt)], f"item_id long, probe int, sub {word}, stt {word}")
    got = {r.probe: (r.deltas, r.coverage) for r in align.align_probe(rows).collect()}
    assert got == {0: ([100, 200], 0.75), 1: ([], 0.0), 2: ([], 0.0)}


def test_merged_run_is_not_padded_again(spark):
    cols = "item_id long, idx int, canonical string, start double, end double, source string, mute_start double, mute_end double"
    prior = spark.createDataFrame([(1, 0, "a", 1.0, 4.0, "subtitle", 0.9, 4.1), (1, 1, "b", 20.0, 20.5, "both", 19.9, 20.6)], cols)
    found = spark.createDataFrame([(1, 0, "a", 2.0, 2.5, "stt", 1.9, 2.6), (1, 1, "c", 20.6, 21.0, "stt", 20.5, 21.1), (1, 2, "b", 20.0, 20.5, "stt", 19.9, 20.6)], cols)
    outcome = spark.createDataFrame([(1, 0, 0, "improved"), (1, 1, None, "new"), (1, 2, 1, "matched")], "item_id long, idx int, prior_idx int, outcome string")
    rows, mutes = scoring.merged_run(prior, found, outcome)
    assert sorted((r.canonical, r.part) for r in rows.collect()) == [("a", "improved"), ("b", "carried"), ("c", "new")]
    assert sorted((r.start, r.end) for r in mutes.collect()) == [(1.9, 2.6), (19.9, 21.1)]


def test_rules_in_any_order_give_one_fingerprint(spark):
    items = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "item_id long, title_id long")
    rules = [("a", "global", None, "", "suppress"), ("b", "title", 10, "", "allow"), ("c", "item", 2, "", "allow")]
    kind = "canonical string, scope string, scope_id long, context_text string, mode string"
    prints = [{r.item_id: r.fingerprint for r in lexicon.ruleset_fingerprint(items, "v", spark.createDataFrame(x, kind)).collect()} for x in (rules, rules[::-1] + rules[:1])]
    assert prints[0] == prints[1] and prints[0][3] == prints[0][4] and len(set(prints[0].values())) == 3


def test_file_checks(spark):
    streams = "item_id long, kind string, typed_index int, codec string, width int, height int, pix_fmt string, attached_pic boolean, channels int, lang string, title string, flags array<string>, image boolean"
    video = lambda i, k, codec="h264", pic=False: (i, "video", k, codec, 1920, 1080, "yuv420p", pic, None, None, None, [], None)
    audio = lambda i, k, codec, ch, lang, title, flags: (i, "audio", k, codec, None, None, None, None, ch, lang, title, flags, None)
    sub = lambda i, k, codec, image=False: (i, "subtitle", k, codec, None, None, None, None, None, "eng", None, [], image)
    source = [video(1, 0), video(1, 1, "png", True), audio(1, 0, "dts", 6, "eng", None, ["comment", "default"]), sub(1, 0, "mov_text"), sub(1, 1, "pgs", True), video(2, 0), audio(2, 0, "ac3", 2, None, None, []), sub(2, 0, "pgs", True), video(3, 0)]
    output = [video(1, 0), audio(1, 0, "flac", 6, "en", "Clean", ["default"]), audio(1, 1, "dts", 6, "eng", "Original", ["comment"]), sub(1, 0, "subrip"), sub(1, 1, "pgs", True),
              audio(2, 0, "ac3", 6, "fra", "x", []), audio(2, 1, "ac3", 2, None, "y", ["default"]), sub(2, 0, "subrip", True), video(3, 0, "hevc")]
    files = "item_id long, duration double, size long, chapters int, attachments int, tags map<string,string>"
    before = [(1, 60.0, 100, 3, 1, {}), (2, 60.0, 100, 3, 1, {}), (3, 60.0, 100, 0, 0, {}), (4, 1.0, 1, 0, 0, {})]
    after = [(1, 60.5, 90, 1, 1, {"SRC_FP": "f", "V": "1"}), (2, 60.6, 89, 0, 0, {"SRC_FP": "g"}), (3, 60.0, 100, 0, 0, {"SRC_FP": "f", "V": "1"})]
    plan = [(i, "flac", None if i == 2 else "eng", 0, 1, {"SRC_FP": "f", "V": "1"}) for i in (1, 2, 3, 4)]
    make = spark.createDataFrame
    checks = media.compare_streams(make(source, streams), make(output, streams), make(before, files), make(after, files), make(plan, "item_id long, encoder string, language string, source_audio int, original int, tags map<string,string>"))
    got = {}
    for r in checks.collect():
        got.setdefault(r.item_id, {})[r.check] = (r.ok, r.severity)
    assert len(got[1]) == 20 and [c for c, (ok, _) in got[1].items() if not ok] == [] and 4 not in got
    failed = {c: s for c, (ok, s) in got[2].items() if not ok}
    assert failed == {
        "video_streams_identical": "fatal", "clean_track_title": "fatal", "clean_track_default": "fatal", "clean_track_codec": "warn", "clean_track_channels": "fatal", "clean_track_language": "warn", "original_track_title": "warn",
        "bitmap_subtitles_untouched": "fatal", "chapters_preserved": "fatal", "attachments_preserved": "warn", "duration_within_tolerance": "fatal", "output_size_floor": "fatal", "idempotency_tags": "fatal", "source_fingerprint_tag": "fatal",
    }
    assert {c for c, (ok, _) in got[3].items() if not ok} == {"audio_stream_count", "video_streams_identical", "clean_track_is_audio_zero", "single_default_audio"}
    assert {r.item_id: (r.passed, r.failed) for r in media.verdicts(checks).collect()} == {1: (True, 0), 2: (False, 14), 3: (False, 4)}


def test_track_choice_with_nothing_known(spark):
    rows = spark.createDataFrame([(1, 0, False, None, None, False), (1, 1, True, None, True, False), (1, 2, False, "en", False, True)], "item_id long, track int, sidecar boolean, lang string, forced boolean, image boolean")
    assert [r.track for r in media.choose_subtitle(rows, "en").orderBy("place").collect()] == [1, 0, 2]
