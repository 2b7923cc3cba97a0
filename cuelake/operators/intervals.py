"""Ranges per item: merge, pad, cover, probe. Columns: item_id, start, end of any ordered numeric type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import keep, materialise, scratch
from .chains import numbered, reached


def merge_ranges(df: DataFrame, gap: float = 0) -> DataFrame:
    """Ranges of an item that lie at most ``gap`` apart as one; empty ranges are dropped."""
    order = Window.partitionBy("item_id").orderBy("start", "end")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col("end") > F.col("start")).select("item_id", "start", "end", F.when(F.col("start") - last <= gap, 0).otherwise(1).alias("opens"))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("item_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def quantize_outward(df: DataFrame, duration: Column, most: int = 2000) -> DataFrame:
    """Ranges widened to whole milliseconds inside [0, duration] and merged again; more than ``most`` an item is an error."""
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), duration)
    whole = df.select("item_id", (F.floor(cut(F.col("start")) * 1000) / 1000).alias("start"), (F.ceil(cut(F.col("end")) * 1000) / 1000).alias("end"))
    merged = merge_ranges(whole, 0.0).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    return merged.where(F.when(F.col("n") > most, F.raise_error(F.concat(F.lit("too many ranges in "), F.col("item_id").cast("string"))).cast("boolean")).otherwise(True)).drop("n")


def bucketed(df: DataFrame, start: str, end: str, width: float, name: str = "bucket") -> DataFrame:
    """One row for each stretch of ``width`` that a range touches: the equality key of a range join."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


#: How many times as long the stretches of each further level are.
LEVELS_APART = 16


def met_ranges(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:  # noqa: E741
    """All pairs of rows with equal ``keys`` whose ranges ``l`` and ``r`` (start and end) share a stretch of time, each once, and no fewer than those that touch.

    A range of up to ``width`` has stretches of that length, one of up to 16 times as much those 16 times as long, and so on, so it touches two of its
    own at most. A pair meets in the stretches of the longer range, where the shorter one is a guest; guests don't meet each other. So
    rows don't multiply with the length of ranges, and no short range waits in a long stretch for all others of its kind. ``left`` is the smaller side, if one is.
    """

    def levelled(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        size = F.abs(F.col(ends[1]) - F.col(ends[0]))
        return df.withColumn("_own", F.when(size <= width, 0).otherwise(F.ceil(F.log(size / width) / F.log(F.lit(float(LEVELS_APART))))).cast("int"))

    def stretch(c: str) -> Column:
        return F.floor(F.col(c) / (width * F.pow(F.lit(float(LEVELS_APART)), F.col("_lv"))))

    def placed(df: DataFrame, levels: Column, ends: tuple[str, str]) -> DataFrame:
        rows = df.withColumn("_lv", F.explode(levels))
        return rows.withColumn("_b", F.explode(F.sequence(stretch(ends[0]), stretch(ends[1]))))

    a, b = levelled(left, l), levelled(right, r)
    own, up = F.array("_own"), lambda top: F.when(F.col("_own") < top, F.sequence(F.col("_own") + 1, F.lit(top)))
    tops = [x.agg(F.max("_own")).first()[0] or 0 for x in (a, b)]
    host = lambda yes: F.lit(yes).alias("_host")
    # Where the right range is the longer one, or of the same level: it is at home, the left one at home or a guest. Then the other way round.
    guests = F.concat(own, F.coalesce(up(tops[1]), F.array().cast("array<int>"))) if tops[1] else own
    first, second = placed(a, guests, l).select("*", host(True)), placed(b, own, r).select("*", host(True))
    if tops[0]:
        first = first.union(placed(a, own, l).select("*", host(False)))
        second = second.union(placed(b, up(tops[0]), r).select("*", host(False)))
    met = first.drop("_own").join(second.drop("_own"), [*keys, "_host", "_lv", "_b"])
    return met.where(F.col("_b") == F.greatest(stretch(l[0]), stretch(r[0]))).drop("_host", "_lv", "_b")


def overlap_pairs(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Rows of both sides of an item whose ranges touch. Left has item_id, start, end and right item_id, r_start,
    r_end, both with further columns. Each pair comes once (``met_ranges``)."""
    met = met_ranges(left, right, ["item_id"], ("start", "end"), ("r_start", "r_end"), width)
    return met.where((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")))


def coverage(spans: DataFrame, ranges: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``spans`` with ``covered``: the share of each that the (disjoint) ranges of its item cover."""
    pairs = overlap_pairs(spans, ranges.withColumnsRenamed({"start": "r_start", "end": "r_end"}), width)
    share = pairs.groupBy(*keys).agg(F.sum(F.greatest(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0))).alias("hit"))
    size = F.col("end") - F.col("start")
    return spans.join(share, keys, "left").withColumn("covered", F.when(size > 0, F.least(F.lit(1.0), F.coalesce("hit", F.lit(0)) / size)).otherwise(0.0)).drop("hit")


def free_window(ranges: DataFrame, durations: DataFrame, size: int, margin: int, step: int) -> DataFrame:
    """(item_id, free_start): a stretch of ``size`` clear of all ranges by ``margin``, nearest to the middle; right before left. Starts are
    tried ``step`` apart from the middle on.

    What the ranges forbid is merged first; each gap then has one start that is nearest to the middle, so nothing is tried in a
    place that is taken.
    """
    limits = durations.where(F.col("duration") >= size).select("item_id", (F.col("duration") - size).alias("limit")).withColumn("mid", F.floor(F.col("limit") / 2))
    # A start is forbidden within these bounds, not on them.
    barred = merge_ranges(ranges.select("item_id", (F.col("start") - margin - size).alias("start"), (F.col("end") + margin).alias("end")), -1e-9)
    item = Window.partitionBy("item_id").orderBy("start")
    before = barred.select("item_id", F.lag("end").over(item).alias("lo"), F.col("start").alias("hi"))
    after = limits.select("item_id").join(barred.groupBy("item_id").agg(F.max("end").alias("lo")), "item_id", "left").withColumn("hi", F.lit(None).cast(before.schema["hi"].dataType))
    gaps = before.union(after.select("item_id", "lo", "hi")).join(limits, "item_id")
    gaps = gaps.withColumns({"lo": F.greatest(F.coalesce("lo", F.lit(0)), F.lit(0)), "hi": F.least(F.coalesce("hi", "limit"), "limit")}).where("lo <= hi")
    lo, hi, mid = F.col("lo"), F.col("hi"), F.col("mid")
    at = F.when((lo <= mid) & (mid <= hi), mid).when(lo > mid, mid + F.ceil((lo - mid) / step) * step).otherwise(mid + F.floor((hi - mid) / step) * step)
    tried = gaps.withColumn("at", at.cast("long")).where("at between lo and hi")
    return tried.groupBy("item_id").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("mid")), -F.col("at"))).alias("free_start"))


def events_to_intervals(df: DataFrame, clears: Column, tail: int) -> DataFrame:
    """An event lasts until the next later time of its item, the last one ``tail`` longer; clearing events emit nothing. ``at`` is a whole number."""
    # From the last event on, so that the least time so far is carried along.
    later = Window.partitionBy("item_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("end", F.coalesce(F.min("at").over(later), F.col("at") + tail)).where(~clears).withColumnRenamed("at", "start")


def longest_ranges(df: DataFrame, k: int = 3, least: float = 0.25, inset: float = 0.04) -> DataFrame:
    """The ``k`` longest ranges of an item, drawn in by ``inset`` at both ends."""
    order = Window.partitionBy("item_id").orderBy(F.desc(F.col("end") - F.col("start")), "start")
    top = df.where(F.col("end") - F.col("start") >= least).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return top.select("item_id", (F.col("start") + inset).alias("start"), (F.col("end") - inset).alias("end"))


def cue_windows(cues: DataFrame, hits: DataFrame, pad: float, gap: float, offset: float = 0) -> DataFrame:
    """Stretches to listen to: cues with a hit, padded and merged."""
    held = cues.join(hits.select("item_id", "cue_index").distinct(), ["item_id", "cue_index"], "left_semi")
    wide = held.select("item_id", F.greatest(F.col("start") + offset - pad, F.lit(0)).alias("start"), (F.col("end") + offset + pad).alias("end"))
    return merge_ranges(wide, gap)


def batch_segments(df: DataFrame, max_span: float = 300, max_n: int = 128) -> DataFrame:
    """Number of the batch of each segment (item_id, start, end, in order of both, nulls last): a batch ends before it spans ``max_span`` or holds ``max_n``;
    a segment without a start or end doesn't end one by its span. ``df`` with ``batch``, from 0.

    Where a batch would end if it began with a segment is told by at most ``max_n`` segments after it, stretch by stretch of an item; which
    segments do begin one is a chain. An item with a third of all segments is numbered, searched and followed by many tasks.
    """
    spark, item = df.sparkSession, F.struct("item_id")
    nulls_last = [F.asc_nulls_last(c) for c in ("start", "end")]
    with scratch(spark):
        rows = materialise(numbered(df.withColumn("_k", item), ["_k"], nulls_last, "_idx"), "segments")
        size = F.lit(16 * max_n)
        spans = rows.select("_k", F.col("_idx"), F.floor(F.col("_idx") / size).alias("_c"), F.col("start").cast("double").alias("s"), F.coalesce(F.col("end").cast("double"), F.lit(float("-inf"))).alias("e"))
        # The first ones of a stretch also stand behind the one before.
        behind = spans.where(f"_c > 0 and _idx % {16 * max_n} < {max_n}").withColumn("_c", F.col("_c") - 1)
        both = spans.withColumn("mine", F.lit(True)).union(behind.withColumn("mine", F.lit(False)))
        ahead = F.collect_list("e").over(Window.partitionBy("_k", "_c").orderBy("_idx").rowsBetween(1, max_n))
        placed = both.withColumn("ahead", ahead).where("mine")
        far = F.array_position(F.transform("ahead", lambda e: F.coalesce(e - F.col("s") > max_span, F.lit(False))), F.lit(True))
        step = F.when(far > 0, far).when(F.size("ahead") == max_n, F.lit(max_n))
        begins = materialise(reached(placed.select("_k", F.col("_idx").alias("idx"), (F.col("_idx") + step).alias("next")), ["_k"]), "begins")
        # How many begin up to each segment: counted by stretches, then within.
        flags = rows.join(begins.select("_k", F.col("idx").alias("_idx"), F.lit(1).alias("_one")), ["_k", "_idx"], "left").withColumn("_c", F.floor(F.col("_idx") / 4096))
        counts = begins.withColumn("_c", F.floor(F.col("idx") / 4096)).groupBy("_k", "_c").agg(F.count("*").alias("_n"))
        before = flags.select("_k", "_c").distinct().join(counts, ["_k", "_c"], "left")
        before = before.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        inside = Window.partitionBy("_k", "_c").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
        out = flags.join(before, ["_k", "_c"]).withColumn("batch", (F.col("_base") + F.coalesce(F.sum("_one").over(inside), F.lit(0)) - 1).cast("int"))
        return keep(materialise(out.select(*df.columns, "batch"), "batches"))


def stage_progress(events: DataFrame, weights: dict[str, int], completed: DataFrame | None = None, tables: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """``percent`` done at each event (run_id, seq, stage, part): weights of the planned stages before, and of this one as far as ``part`` goes, kept between 0 and 1; never falling.

    ``weights`` has the planned stages in order. A stage that isn't planned leaves the percentage as it is. ``completed`` (run_id, stage): what a resumed run has
    behind it, and starts from. ``tables``: other weights of the planned stages by name (1 where one has none), in force from an event on whose column ``weights`` names them."""
    spark, rows = events.sparkSession, []
    for name, table in [(None, weights), *(tables or {}).items()]:
        each = {stage: table.get(stage, 1) for stage in weights}
        before, total = 0, sum(each.values()) or 1
        for stage, w in each.items():
            rows.append((name, stage, before, w, total))
            before += w
    # As many rows as stages and tables.
    plan = F.broadcast(spark.createDataFrame(rows, "_table string, stage string, before int, weight int, total int"))
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = events.withColumn("_of", F.last("weights", ignorenulls=True).over(order) if tables else F.lit(None).cast("string"))
    now = now.join(plan.withColumnRenamed("stage", "_stage"), (F.col("stage") == F.col("_stage")) & F.col("_of").eqNullSafe(F.col("_table")), "left")
    raw = (F.col("before") + F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("part")))) * 100 / F.col("total")
    percent = F.coalesce(F.max(raw).over(order), F.lit(0.0))
    if completed is not None:
        done = completed.join(plan.where("_table is null"), "stage").groupBy("run_id").agg(F.max((F.col("before") + F.col("weight")) * 100 / F.col("total")).alias("_floor"))
        now = now.join(done, "run_id", "left")
        percent = F.greatest(percent, F.coalesce("_floor", F.lit(0.0)))
    return now.withColumn("percent", percent).select(*events.columns, "percent")
