"""Detections against other detections and against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import related
from .claims import claim_first
from .intervals import coverage, merge_ranges, met_ranges, overlap_pairs
from .medians import exact_medians


def claim_pairs(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one choice per item: in order of ``left`` (then ``order``) each takes its first right side that is free."""
    return claim_first(pairs, left, right, [F.col(c) for c in order])


def compare_runs(prior: DataFrame, found: DataFrame, slack: int = 1000, width: int = 60_000) -> DataFrame:
    """What ``found`` adds to ``prior`` (both item_id, idx, canonical, start, end, source; prior also mute_start and
    mute_end): item_id, idx, outcome new, matched or improved. Found ones claim the first prior that covers them."""
    p = prior.select("item_id", F.col("idx").alias("prior_idx"), F.col("canonical").alias("pc"), F.col("source").alias("ps"), (F.col("end") - F.col("start")).alias("psize"), (F.col("mute_start") - slack).alias("p0"), (F.col("mute_end") + slack).alias("p1"))
    f = found.select("item_id", "idx", "canonical", "start", "end", "source")
    pairs = met_ranges(f, p, ["item_id"], ("start", "end"), ("p0", "p1"), width).where((F.col("end") >= F.col("p0")) & (F.col("start") <= F.col("p1")) & related(F.col("canonical"), F.col("pc")))
    better = (F.col("ps") == "subtitle") & (F.col("source") != "subtitle") & (F.col("end") - F.col("start") < F.col("psize"))
    got = claim_pairs(pairs.select("item_id", "idx", "prior_idx", better.alias("better")), "idx", "prior_idx", ["prior_idx"])
    joined = found.select("item_id", "idx").join(got, ["item_id", "idx"], "left")
    return joined.select("item_id", "idx", "prior_idx", F.when(F.col("prior_idx").isNull(), "new").when(F.col("better"), "improved").otherwise("matched").alias("outcome"))


def promotable(found: DataFrame, outcomes: DataFrame, floor: float = 0.0) -> DataFrame:
    """Of ``found`` what is new, muted, not whitelisted and heard with a confidence of ``floor`` or with none told: worth a run of its own."""
    new = outcomes.where("outcome = 'new'").select("item_id", "idx")
    sure = F.col("confidence").isNull() | (F.col("confidence") >= floor)
    return found.where(F.col("muted") & ~F.coalesce("whitelisted", F.lit(False)) & sure).join(new, ["item_id", "idx"], "left_semi")


def score_detections(labels: DataFrame, detections: DataFrame, slack: int = 500, width: int = 60_000) -> DataFrame:
    """Labels (item_id, label_no in order of time, word, start, end) with the detection that finds each, or null: same
    word, overlapping by more than -``slack``, nearest middle, each detection once."""
    l0 = labels.withColumns({"_l0": F.col("start") - slack, "_l1": F.col("end") + slack})
    d = detections.select("item_id", F.col("idx").alias("det_idx"), F.col("canonical").alias("word"), F.col("start").alias("d0"), F.col("end").alias("d1"))
    pairs = met_ranges(l0, d, ["item_id", "word"], ("_l0", "_l1"), ("d0", "d1"), width).where((F.col("_l0") < F.col("d1")) & (F.col("d0") < F.col("_l1")))
    away = F.abs((F.col("d0") + F.col("d1")) / 2 - (F.col("start") + F.col("end")) / 2)
    got = claim_pairs(pairs.select("item_id", "label_no", "det_idx", away.alias("away"), F.abs(F.col("d0") - F.col("start")).alias("timing_error")), "label_no", "det_idx", ["away", "det_idx"])
    return labels.join(got, ["item_id", "label_no"], "left")


def clip_scores(labels: DataFrame, detections: DataFrame, ranges: DataFrame, negatives: DataFrame, slack: int = 500) -> tuple[DataFrame, DataFrame]:
    """(scored, per clip). ``scored``: labels (item_id, label_no, word, start, end, verified) with det_idx, and for verified ones timing_error
    (null if not found) and covered, the share of the label that the mute ``ranges`` silence. Per clip: tp, fn, fp, and negatives
    (item_id, start, end) that any range touches, as ``violated``."""
    found = score_detections(labels, detections, slack)
    spans = found.select("item_id", "label_no", "start", "end")
    muted = coverage(spans, ranges, ["item_id", "label_no"], 60_000).select("item_id", "label_no", "covered")
    scored = found.join(muted, ["item_id", "label_no"], "left")
    share = F.when(F.col("verified"), F.when(F.col("det_idx").isNull(), 0.0).otherwise(F.coalesce("covered", F.lit(0.0))))
    scored = scored.withColumn("covered", share).withColumn("timing_error", F.when(F.col("verified"), F.col("timing_error")))
    counts = scored.groupBy("item_id").agg(F.count("det_idx").alias("tp"), F.count_if(F.col("det_idx").isNull()).alias("fn"))
    used = scored.where("det_idx is not null").select("item_id", F.col("det_idx").alias("idx"))
    spare = detections.select("item_id", "idx").join(used, ["item_id", "idx"], "left_anti").groupBy("item_id").agg(F.count("*").alias("fp"))
    touched = overlap_pairs(negatives.withColumn("_n", F.monotonically_increasing_id()), ranges.select("item_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), 60_000)
    bad = touched.where("start < r_end and r_start < end").groupBy("item_id").agg(F.count_distinct("_n").alias("violated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    per = counts.join(spare, "item_id", "full").join(bad, "item_id", "full").select("item_id", *[zero(c) for c in ("tp", "fn", "fp", "violated")])
    return scored, per


def timing_metrics(scored: DataFrame) -> DataFrame:
    """One row over all clips: median and mean timing error and mean coverage of the verified labels; null without any."""
    means = scored.agg(F.avg("timing_error").alias("mean_error"), F.avg("covered").alias("mean_coverage"))
    return exact_medians(scored, [], "timing_error", "median_error").crossJoin(means)  # one row each


def eval_metrics(counts: DataFrame) -> DataFrame:
    """Sums of tp, fp, fn over all rows with precision, recall (1 when empty) and F1."""
    s = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = s.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0))
    s = s.withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def median_run(runs: DataFrame) -> DataFrame:
    """Of the repeats of a setting, the one in the middle by (f1, precision), with the range of false positives."""
    part = Window.partitionBy("setting")
    ranked = runs.withColumn("nth", F.row_number().over(part.orderBy("f1", "precision", "run_no")) - 1).withColumn("n", F.count("*").over(part))
    ranked = ranked.withColumn("fp_min", F.min("fp").over(part)).withColumn("fp_max", F.max("fp").over(part))
    return ranked.where("nth = n div 2").drop("nth", "n")


def merged_run(prior: DataFrame, found: DataFrame, outcomes: DataFrame, gap: float = 0) -> tuple[DataFrame, DataFrame]:
    """The run that an audit leads to, as detections and as mute ranges: prior ones that nothing improved, and found ones
    that are new or improve one. Both sides have mute_start and mute_end, padded already; they are merged, not padded again."""
    cols = ["item_id", "canonical", "start", "end", "source", "mute_start", "mute_end"]
    better = outcomes.where("outcome = 'improved'").select("item_id", F.col("prior_idx").alias("idx"))
    carried = prior.join(better, ["item_id", "idx"], "left_anti").select(*cols, F.lit("carried").alias("part"))
    added = found.join(outcomes.where("outcome != 'matched'").select("item_id", "idx", F.col("outcome").alias("part")), ["item_id", "idx"]).select(*cols, "part")
    rows = carried.union(added)
    return rows, merge_ranges(rows.select("item_id", F.col("mute_start").alias("start"), F.col("mute_end").alias("end")), gap)
