"""Scalar decision rules. Times are seconds unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_span(start: Column, end: Column, duration: Column, pre: float = 0.08, post: float = 0.12, least: float = 0.02) -> tuple[Column, Column]:
    """Padded span, not before 0 and not past a known duration, at least ``least`` long."""
    a = F.greatest(F.lit(0.0), start - pre)
    cut = lambda x: F.when(duration > 0, F.least(duration, x)).otherwise(x)
    b = cut(end + post)
    return a, F.when(b - a < least, cut(a + least)).otherwise(b)


def guard_span(start: Column, end: Column, cue_start: Column, cue_end: Column, offset: Column, longest: float = 3.0, farthest: float = 2.5, around: float = 0.4, fallback: tuple[Column, Column] | None = None) -> Column:
    """Struct (start, end, suspicious, reason): a span too long or too far from its cue falls back to the ``fallback`` (start, end) given for it, else to the cue
    or, without one, to one second. Length is tested first, before any padding."""
    has_cue = cue_start.isNotNull()
    drift = F.abs((start + end) / 2 - ((cue_start + cue_end) / 2 + offset))
    reason = F.when(end - start > longest, "length").when(has_cue & (drift > farthest), "distance")
    given, (f0, f1) = (fallback[0].isNotNull(), fallback) if fallback else (F.lit(False), (F.lit(None), F.lit(None)))
    a = F.when(reason.isNull(), start).when(given, f0).when(has_cue, F.greatest(F.lit(0.0), cue_start + offset - around)).otherwise(start)
    b = F.when(reason.isNull(), end).when(given, f1).when(has_cue, cue_end + offset + around).otherwise(start + 1.0)
    return F.struct(a.alias("start"), b.alias("end"), reason.isNotNull().alias("suspicious"), reason.alias("reason"))


def clip_window(start: Column, end: Column, duration: Column, size: float = 5.0) -> Column:
    """Struct (start, end, rel_start, rel_end): a review window around a span, shifted into [0, duration]."""
    wide = F.greatest(F.lit(size), end - start)
    a = F.greatest(F.lit(0.0), F.least((start + end) / 2 - wide / 2, duration - wide))
    b = F.least(duration, a + wide)
    return F.struct(a.alias("start"), b.alias("end"), (start - a).alias("rel_start"), (end - a).alias("rel_end"))


def shift_clock(c: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0.0), c - offset)


def item_status(state: Column, dry_run: Column) -> Column:
    return (
        F.when(state == "already_clean", "already_clean").when(state == "failed", "failed").when(state == "stale", "stale")
        .when(dry_run, "pending").when(state == "done", "clean").otherwise("pending")
    )


def resolve_mode(wanted: Column, usable: Column, cues: Column, windows: Column, seconds: Column, cap_hours: Column | float = 4.0) -> Column:
    """Struct (mode, reason). ``windowed`` is what is done unless something else is asked for, and then that wins, whatever the cap. Without
    usable subtitles (``usable``), or without ``cues``, everything is listened to, unless that takes more than ``cap_hours``; 0 is no cap.
    Cues without a window (``windows``) are evidence that there is nothing. Modes and reasons are fixed values."""
    says = lambda mode, reason: F.struct(mode.alias("mode"), reason.alias("reason"))
    windowed, full = F.lit("windowed"), F.lit("full")
    cap = F.coalesce(F.lit(cap_hours) if isinstance(cap_hours, float | int) else cap_hours, F.lit(0.0)) * 3600
    return (
        F.when(wanted != "windowed", says(wanted, F.lit("explicit")))
        .when(usable & cues & windows, says(windowed, F.lit("subtitles")))
        .when(usable & cues, says(windowed, F.lit("no_candidate_windows")))
        .when((cap > 0) & (seconds > cap), says(windowed, F.lit("full_skipped_too_long")))
        .otherwise(says(full, F.when(~usable, "subtitles_unusable").otherwise("no_subtitles")))
    )


def drift_verdict(
    probes: Column, heard: Column, coverage: Column, timed: Column, offset: Column, spread: Column,
    least_probes: int = 2, least_heard: int = 8, least_coverage: float = 0.4, least_timed: int = 2, most_offset: float = 0.7, most_spread: float = 0.5,
) -> Column:
    """Struct (action, reason); the order of the tests matters. Actions and reasons are fixed values."""
    verdict = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    return (
        F.when(probes < least_probes, verdict("skipped", "too_few_probes"))
        .when(heard < least_heard, verdict("skipped", "no_speech_in_probes"))
        .when(coverage < least_coverage, verdict("discard", "coverage_below_threshold"))
        .when(timed < least_timed, verdict("skipped", "too_few_anchors"))
        .when(F.abs(offset) > most_offset, verdict("unreliable", "offset_above_threshold"))
        .when(spread > most_spread, verdict("unreliable", "spread_above_threshold"))
        .otherwise(verdict("ok", "within_thresholds"))
    )


#: Seconds until the next attempt, after each one made; most attempts; stages after which a failure costs little, and those that end a run.
BACKOFF, MOST_ATTEMPTS = (60.0, 300.0, 900.0), 3
BEST_EFFORT_STAGES, TERMINAL_STAGES = ("refresh", "snippets"), ("render", "verify", "swap")
MOVED_DELAY, BLIND_DELAY = 5.0, 60.0


def retry_plan(stage: Column, error: Column, attempts: Column, resolved: Column) -> Column:
    """Struct (verdict, state, delay) of a failed stage; the order of the tests matters.

    ``error``: ``swap_broken``, ``stale_source``, or anything else. ``resolved``: where a lost source went, ``moved``, ``gone``,
    ``unchanged``, ``unavailable`` or null if nobody asked. A moved source is queued again, one of which nothing is known once.
    """
    says = lambda verdict, state, delay=None: F.struct(F.lit(verdict).alias("verdict"), F.lit(state).alias("state"), (F.lit(delay).cast("double") if delay is None or isinstance(delay, float) else delay).alias("delay"))
    nth = F.greatest(F.lit(1), F.least(attempts.cast("int"), F.lit(len(BACKOFF))))
    unknown = resolved.isNull() | (resolved == "unavailable")
    stale = (
        F.when(resolved == "moved", says("stale", "queued", MOVED_DELAY))
        .when(unknown & (attempts <= 1), says("stale", "queued", BLIND_DELAY)).otherwise(says("stale", "stale"))
    )
    return (
        F.when(error == "swap_broken", says("terminal", "failed")).when(error == "stale_source", stale)
        .when(stage.isin(*BEST_EFFORT_STAGES), says("best_effort", "done"))
        .when(stage.isin(*TERMINAL_STAGES) | (attempts >= MOST_ATTEMPTS), says("terminal", "failed"))
        .otherwise(says("retry", "queued", F.element_at(F.array(*[F.lit(x) for x in BACKOFF]), nth)))
    )


def is_pre_existing(kind: Column, added: Column, watermark: Column) -> Column:
    """Series items from before their watermark; movies never."""
    return (kind == "series") & watermark.isNotNull() & (added.isNull() | (added < watermark))


def stream_bitrate(bit_rate: Column, tags: Column, duration: Column) -> Column:
    """The field, else a ``bps*`` tag, else ``number_of_bytes*`` by the duration; null if none is a number."""
    tag = lambda prefix: F.element_at(F.map_values(F.map_filter(tags, lambda k, v: F.lower(k).startswith(prefix))), 1)
    first = lambda prefix: F.when(F.size(F.map_filter(tags, lambda k, v: F.lower(k).startswith(prefix))) > 0, tag(prefix))
    return F.coalesce(
        bit_rate.try_cast("bigint"), first("bps").try_cast("bigint"),
        F.when(duration > 0, first("number_of_bytes").try_cast("bigint") * 8 / duration).cast("bigint"),
    )


def stream_duration(field: Column, tag: Column) -> Column:
    """Seconds of the field, else of an ``H:M:S`` tag."""
    p = F.split(tag, ":")
    return F.coalesce(field.try_cast("double"), F.when(F.size(p) == 3, p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")))


#: Fixed values of the audio plan: codecs without a lossy way back, lossy ones that become AAC, and bits per second.
LOSSLESS_CODECS = (
    "dts", "dts_hd", "truehd", "mlp", "flac", "alac", "wavpack", "tta", "ape", "dsd_lsbf", "dsd_msbf", "dsd_lsbf_planar", "dsd_msbf_planar",
    "pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be", "pcm_s32le", "pcm_s32be", "pcm_f32le", "pcm_f64le", "pcm_dvd", "pcm_bluray",
)
LOSSY_CODECS = ("opus", "vorbis", "mp3", "mp2", "mp1", "wmav1", "wmav2", "wmapro", "cook", "sipr", "amrnb")
SANE_RATES = (32_000, 8_000_000)
AAC_PER_PAIR = (160_000, 256_000)
AC3_RATES = (192_000, 640_000)
EAC3_BY_CHANNELS = {1: 96_000, 2: 224_000, 3: 384_000, 4: 384_000, 5: 640_000, 6: 640_000}
EAC3_TOP = 1_024_000


def audio_plan(codec: Column, profile: Column, channels: Column, bit_rate: Column, lossless: Column, depth: Column | None = None) -> Column:
    """Struct (encoder, bit_rate, sample_format, reason) for the new audio track; the first rule that fits wins.

    FLAC where ``lossless`` is asked for, for more than six channels, for TrueHD with Atmos and for lossless codecs; it
    has no bit rate, and 32-bit samples from a ``depth`` over 16. E-AC-3, AC-3 and AAC stay what they are; every other codec becomes AAC. A source
    bit rate out of ``SANE_RATES`` counts as unknown. Null channels count as one, a null codec as unknown.
    """
    name, n = F.lower(F.coalesce(codec, F.lit(""))), F.greatest(F.lit(1), F.coalesce(channels.cast("int"), F.lit(1)))
    known = F.coalesce(F.when(bit_rate.between(*SANE_RATES), bit_rate.cast("bigint")), F.lit(0))
    pairs = F.floor((n + 1) / 2)
    aac = F.greatest(AAC_PER_PAIR[0] * pairs, F.least(AAC_PER_PAIR[1] * pairs, known))
    ac3 = F.when(n >= 3, AC3_RATES[1]).otherwise(F.least(F.lit(AC3_RATES[1]), F.greatest(F.lit(AC3_RATES[0]), known)))
    table = F.create_map(*[F.lit(x) for pair in EAC3_BY_CHANNELS.items() for x in pair])
    eac3 = F.greatest(F.coalesce(F.try_element_at(table, n), F.lit(AC3_RATES[1])), F.least(F.lit(EAC3_TOP), known))
    none, deep = F.lit(None), F.when(F.coalesce(depth, F.lit(16)) > 16, "s32").otherwise("s16") if depth is not None else F.lit("s16")
    plans = [
        (lossless, "flac", none, "forced_lossless"),
        (n > 6, "flac", none, "channels_gt_6"),
        ((name == "truehd") & F.lower(profile).contains("atmos"), "flac", none, "truehd_atmos"),
        (name.isin(*LOSSLESS_CODECS), "flac", none, "lossless_source"),
        (name == "eac3", "eac3", eac3, "eac3_passthrough"),
        (name == "ac3", "ac3", ac3, "ac3_passthrough"),
        (name == "aac", "aac", aac, "aac_passthrough"),
        (name.isin(*LOSSY_CODECS), "aac", aac, "lossy_fallback_aac"),
        (F.lit(True), "aac", aac, "unknown_codec_fallback"),
    ]
    out = None
    for test, encoder, rate, reason in plans:
        plan = F.struct(
            F.lit(encoder).alias("encoder"), rate.cast("bigint").alias("bit_rate"),
            (deep if encoder == "flac" else none).cast("string").alias("sample_format"), F.lit(reason).alias("reason"),
        )
        out = F.when(test, plan) if out is None else out.when(test, plan)
    return out
