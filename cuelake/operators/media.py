"""Streams of media files: which one to use, and whether a new file kept what it should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lang_matches, lang_norm


#: Why a track may be used, best first.
SUBTITLE_REASONS = (
    "sidecar_preferred_language", "sidecar_untagged", "embedded_preferred_language", "embedded_preferred_language_forced",
    "embedded_any_text", "embedded_forced_only", "ocr_preferred_language", "ocr_preferred_language_forced", "ocr_any",
)


def choose_subtitle(tracks: DataFrame, language: str, ocr: bool = True) -> DataFrame:
    """The candidates among ``tracks`` (item_id, track, sidecar, lang, forced, image) with ``reason`` and ``place``, 1 for the best.

    A sidecar counts if it is in the language; one without a language counts where the item has none in it; others are
    no candidates. Text streams follow, in the language first and others after them, not forced before forced. Pictures
    of text come last, with an order of their own, and only with ``ocr``. Ties: by ``track``.
    """
    mine, untagged = lang_matches(F.col("lang"), F.lit(language)), F.coalesce(lang_norm(F.col("lang")), F.lit("und")) == "und"
    side, image, forced = (F.coalesce(F.col(c), F.lit(False)) for c in ("sidecar", "image", "forced"))
    item = Window.partitionBy("item_id")
    own = F.max(side & mine).over(item)
    place = (
        F.when(side, F.when(mine, 0).when(~own & untagged, 1))
        .when(image, F.when(F.lit(ocr), F.when(mine & ~forced, 6).when(mine, 7).otherwise(8)))
        .otherwise(F.when(mine & ~forced, 2).when(mine, 3).when(~forced, 4).otherwise(5))
    )
    ranked = tracks.withColumn("rank", place).where("rank is not null")
    reason = F.array(*[F.lit(r) for r in SUBTITLE_REASONS])[F.col("rank")]
    return ranked.withColumn("reason", reason).withColumn("place", F.row_number().over(item.orderBy("rank", "track"))).drop("rank")


def choose_audio(streams: DataFrame, language: str) -> DataFrame:
    """(item_id, track): of ``streams`` (item_id, track, lang, is_default, commentary) those in the language, else those
    without one, else the default ones, else all; of these the main programme, then the default flag, then the first."""
    mine, untagged = lang_matches(F.col("lang"), F.lit(language)), F.coalesce(lang_norm(F.col("lang")), F.lit("und")) == "und"
    pool = F.when(mine, 0).when(untagged, 1).when(F.col("is_default"), 2).otherwise(3)
    return streams.groupBy("item_id").agg(F.min_by("track", F.struct(pool, F.col("commentary"), ~F.col("is_default"), "track")).alias("track"))


#: Titles of the two tracks, the tag that names the source, changes of subtitle codec that are meant to be.
CLEAN_TITLE, ORIGINAL_TITLE, SOURCE_TAG = "Clean", "Original", "SRC_FP"
SUBTITLE_CHANGES = (("mov_text", "subrip"), ("text", "subrip"))


def _file(streams: DataFrame, files: DataFrame, side: str) -> DataFrame:
    """One row per item: a struct of its file with arrays of its streams in order."""

    def of(kind: str, *columns: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("typed_index", *columns))))
        return F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(kind)

    per = streams.groupBy("item_id").agg(
        of("video", "codec", "width", "height", "pix_fmt", "attached_pic"), of("audio", "codec", "channels", "lang", "title", "flags"), of("subtitle", "codec", "image")
    )
    empty = lambda kind: F.coalesce(kind, F.array().cast(dict(per.dtypes)[kind])).alias(kind)
    joined = files.join(per, "item_id", "left")
    return joined.select("item_id", F.struct("duration", "size", "chapters", "attachments", "tags", *[empty(k) for k in ("video", "audio", "subtitle")]).alias(side))


def compare_streams(source: DataFrame, output: DataFrame, source_files: DataFrame, output_files: DataFrame, plan: DataFrame, tolerance: float = 0.5, floor: float = 0.9) -> DataFrame:
    """Whether new files kept what they should: item_id, check, severity, expected, actual, ok; 20 checks, of which those on the clean track
    need an audio stream and those on the original track need that track.

    Streams: item_id, kind, typed_index, codec, width, height, pix_fmt, attached_pic, channels, lang, title, flags (array), image.
    Files: item_id, duration, size, chapters, attachments, tags (map). ``plan``: item_id, encoder, language, source_audio and original (places of the
    audio streams in source and output), tags. Streams are gathered per file, so the joins have one row for each item. An item without
    an output has no checks.
    """
    t = _file(source, source_files, "a").join(_file(output, output_files, "b"), "item_id").join(plan.select("item_id", F.struct(*[c for c in plan.columns if c != "item_id"]).alias("plan")), "item_id")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    text = lambda c: c.cast("string")
    listed = lambda c: F.to_json(c)
    pictures = lambda c: F.transform(F.filter(c, lambda v: ~F.coalesce(v["attached_pic"], F.lit(False))), lambda v: F.struct(v["codec"], v["width"], v["height"], v["pix_fmt"]))
    default = lambda x: F.array_contains(x["flags"], "default")
    clean, wanted_audio = F.get(b("audio"), F.lit(0)), F.get(a("audio"), F.col("plan.source_audio"))
    original = F.get(b("audio"), F.col("plan.original"))
    want, got = lang_norm(F.col("plan.language")), lang_norm(clean["lang"])
    want, got = F.when(want != "und", want), F.when(got != "und", got)
    flags = lambda x: F.array_sort(F.array_remove(x["flags"], "default"))
    pairs = F.filter(F.arrays_zip(a("subtitle").alias("x"), b("subtitle").alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~p["x"]["codec"].eqNullSafe(p["y"]["codec"]))
    meant = lambda p: F.struct(p["x"]["codec"], p["y"]["codec"]).isin([F.struct(F.lit(x), F.lit(y)) for x, y in SUBTITLE_CHANGES])
    images = F.filter(pairs, lambda p: F.coalesce(p["x"]["image"], F.lit(False)))
    codecs = F.filter(pairs, lambda p: ~F.coalesce(p["x"]["image"], F.lit(False)) & ~meant(p))
    n_defaults = F.size(F.filter(b("audio"), default))
    drift = F.abs(a("duration") - b("duration"))
    lost = F.array_except(F.map_keys("plan.tags"), F.map_keys(b("tags")))
    fatal, warn = F.lit("fatal"), F.lit("warn")
    yes, no_clean, no_original = F.lit(True), clean.isNotNull(), original.isNotNull()
    #: Names of the checks, and whether a failure is fatal.
    checks = [
        ("audio_stream_count", fatal, text(F.size(a("audio")) + 1), text(F.size(b("audio"))), F.size(b("audio")) == F.size(a("audio")) + 1, yes),
        ("video_streams_identical", fatal, listed(pictures(a("video"))), listed(pictures(b("video"))), pictures(a("video")) == pictures(b("video")), yes),
        ("clean_track_is_audio_zero", fatal, None, None, no_clean, yes),
        ("clean_track_title", fatal, F.lit(CLEAN_TITLE), clean["title"], clean["title"] == CLEAN_TITLE, no_clean),
        ("clean_track_default", fatal, None, None, default(clean), no_clean),
        ("clean_track_codec", warn, F.col("plan.encoder"), clean["codec"], clean["codec"] == F.col("plan.encoder"), no_clean),
        ("clean_track_channels", fatal, text(wanted_audio["channels"]), text(clean["channels"]), clean["channels"] == wanted_audio["channels"], no_clean),
        ("clean_track_language", F.when(want.isNull() | got.isNull(), warn).otherwise(fatal), want, got, want.eqNullSafe(got), no_clean),
        ("single_default_audio", fatal, F.lit("1"), text(n_defaults), n_defaults == 1, yes),
        ("original_track_title", warn, F.lit(ORIGINAL_TITLE), original["title"], original["title"] == ORIGINAL_TITLE, no_original),
        ("original_dispositions_preserved", warn, listed(flags(wanted_audio)), listed(flags(original)), F.size(F.array_except(flags(wanted_audio), flags(original))) == 0, no_original),
        ("subtitle_stream_count", fatal, text(F.size(a("subtitle"))), text(F.size(b("subtitle"))), F.size(a("subtitle")) == F.size(b("subtitle")), yes),
        ("bitmap_subtitles_untouched", fatal, None, listed(images), F.size(images) == 0, yes),
        ("subtitle_codecs", warn, None, listed(codecs), F.size(codecs) == 0, yes),
        ("chapters_preserved", F.when((a("chapters") > 0) & (b("chapters") == 0), fatal).otherwise(warn), text(a("chapters")), text(b("chapters")), (b("chapters") >= a("chapters")) | (b("chapters") > 0), yes),
        ("attachments_preserved", warn, text(a("attachments")), text(b("attachments")), b("attachments") >= a("attachments"), yes),
        ("duration_within_tolerance", fatal, F.lit(f"<= {tolerance}"), text(drift), drift <= tolerance, yes),
        ("output_size_floor", fatal, F.lit(f">= {floor:g}x"), text(b("size")), b("size") >= a("size") * floor, yes),
        ("idempotency_tags", fatal, listed(F.map_keys("plan.tags")), listed(lost), F.size(lost) == 0, yes),
        ("source_fingerprint_tag", fatal, F.col("plan.tags")[SOURCE_TAG], b("tags")[SOURCE_TAG], b("tags")[SOURCE_TAG].eqNullSafe(F.col("plan.tags")[SOURCE_TAG]), yes),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check"), severity.alias("severity"), (F.lit(None) if expected is None else expected).cast("string").alias("expected"),
            (F.lit(None) if actual is None else actual).cast("string").alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"), there.alias("there"),
        )
        for name, severity, expected, actual, ok, there in checks
    ])
    return t.select("item_id", F.explode(F.filter(rows, lambda c: c["there"])).alias("c")).select("item_id", "c.check", "c.severity", "c.expected", "c.actual", "c.ok")


def ocr_filter(cues: DataFrame, least: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """Cues read from pictures (item_id, cue_index, text, confidence, ...): those that hold text, read with a confidence of ``least``, numbered
    anew from 0 in their order; and per item cues_in, cues_out, dropped_empty, dropped_confidence, mean_confidence (0 without cues)."""
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    weak = ~empty & F.coalesce(F.col("confidence") < least, F.lit(True))
    good = ~empty & ~weak
    order = Window.partitionBy("item_id").orderBy("cue_index")
    kept = cues.where(good).withColumn("cue_index", F.row_number().over(order) - 1)
    stats = cues.groupBy("item_id").agg(
        F.count("*").alias("cues_in"), F.count_if(good).alias("cues_out"), F.count_if(empty).alias("dropped_empty"), F.count_if(weak).alias("dropped_confidence"),
        F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
    )
    return kept, stats


def verdicts(checks: DataFrame) -> DataFrame:
    """(item_id, passed, failed): passed if no fatal check failed."""
    return checks.groupBy("item_id").agg((F.count_if(~F.col("ok") & (F.col("severity") == "fatal")) == 0).alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
