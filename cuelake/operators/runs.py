"""Runs, their detections, and what they say about items and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_run(items: DataFrame, runs: DataFrame) -> DataFrame:
    """(item_id, evidence_run_id): the last run if it is done, failed or stale and no dry run, else the newest such
    run, else the last run."""
    real = runs.where(F.col("state").isin("done", "failed", "stale") & ~F.col("dry_run"))
    newest = real.groupBy("item_id").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("newest"))
    last = items.select("item_id", "last_run_id").join(real.select("item_id", F.col("run_id").alias("last_run_id"), F.lit(True).alias("counts")), ["item_id", "last_run_id"], "left")
    return last.join(newest, "item_id", "left").select("item_id", F.when(F.col("counts"), F.col("last_run_id")).otherwise(F.coalesce("newest", "last_run_id")).alias("evidence_run_id"))


def latest_per_item(runs: DataFrame, *order: Column) -> DataFrame:
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where("nth = 1").drop("nth")


def word_counts(detections: DataFrame, *by: str) -> DataFrame:
    """Per word and category, below the columns ``by``: total, muted and not whitelisted, suspicious."""
    return detections.groupBy(*by, "canonical", "category").agg(
        F.count("*").alias("total"), F.count_if(F.col("muted") & ~F.col("whitelisted")).alias("muted"), F.count_if("suspicious").alias("suspicious")
    )


def word_sources(detections: DataFrame) -> DataFrame:
    """Counts by source for each word as a map: counted per source first, so a word's list is as long as there are sources."""
    two = detections.groupBy("canonical", "source").agg(F.count("*").alias("n"))
    return two.groupBy("canonical").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))


def title_rollup(items: DataFrame, runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Words of each title over the evidence runs of its items; whitelisted detections don't count."""
    evidence = evidence_run(items, runs).join(items.select("item_id", "title_id"), "item_id").select("title_id", F.col("evidence_run_id").alias("run_id"))
    return word_counts(detections.where("not whitelisted").join(evidence, "run_id"), "title_id")


def title_status_counts(titles: DataFrame, items: DataFrame) -> DataFrame:
    c = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    status = F.col("status")
    return titles.select("title_id").join(items.select("title_id", "item_id", "status", "skip"), "title_id", "left").groupBy("title_id").agg(
        F.count("item_id").alias("items"), c(status.isin("clean", "already_clean")).alias("clean"), c(status == "failed").alias("failed"),
        c(status == "pending").alias("pending"), c(status.isin("pending", "failed") & F.col("skip")).alias("deferred"),
    )


def run_stats(detections: DataFrame, sources: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """Per run: detections, muted, suspicious, whitelisted, from_SOURCE; with mute ``ranges`` (run_id, start, end) also their number
    and total length, 0 for runs without."""
    stats = _run_counts(detections, sources)
    if ranges is None:
        return stats
    of = ranges.groupBy("run_id").agg(F.count("*").alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("muted_for"))
    return stats.join(of, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ranges", "muted_for")})


def _run_counts(detections: DataFrame, sources: list[str]) -> DataFrame:
    return detections.groupBy("run_id").agg(
        F.count("*").alias("detections"), F.count_if("muted").alias("muted"), F.count_if("suspicious").alias("suspicious"), F.count_if("whitelisted").alias("whitelisted"),
        *[F.count_if(F.col("source") == s).alias(f"from_{s}") for s in sources],
    )


def backup_summary(backups: DataFrame, today: Column) -> DataFrame:
    due = F.col("purge_after").isNotNull() & (F.col("purge_after") <= today) & F.col("state").isin("kept", "orphaned")
    return backups.groupBy("state").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(due).alias("expired"),
        F.count_if(F.col("purge_after").isNull() & (F.col("state") == "kept")).alias("keeps_forever"),
    )


def lexicon_counts(categories: DataFrame, lexicon: DataFrame) -> DataFrame:
    return categories.join(lexicon, "category", "left").groupBy("category").agg(
        F.count("canonical").alias("entries"), F.count_if(F.coalesce("enabled", F.lit(False))).alias("enabled"),
        F.coalesce(F.sum(F.when(F.col("canonical").isNotNull(), F.size("forms"))), F.lit(0)).alias("forms"),
    )


def last_original(backups: DataFrame) -> DataFrame:
    """``backups`` flagged where they are the only kept original of a clean item."""
    original = (F.col("state") == "kept") & ~F.col("is_subtitle")
    n = F.count_if(original).over(Window.partitionBy("item_id"))
    return backups.withColumn("last_original", original & (n == 1) & (F.col("item_status") == "clean"))


def runnable(runs: DataFrame, now: Column) -> DataFrame:
    """Queued ``runs`` whose retry time is past or that have none; the lowest priority number first, then the oldest."""
    return runs.where((F.col("state") == "queued") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now))).orderBy("priority", "created", "run_id")


def page(df: DataFrame, order: list, limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows in an order, and one row ``total`` with the number of all."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def queued_total(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("state") == "queued").alias("queued"))


def queue_view(runs: DataFrame, n: int) -> DataFrame:
    """Per state group the top ``n``: running by start, queued by priority and age, the others by end; newest first, nulls last.
    ``queued_total`` counts what waits beyond them."""
    group = F.when(F.col("state") == "running", "running").when(F.col("state") == "queued", "queued").otherwise("recent")
    part = Window.partitionBy("part")
    order = [
        F.when(F.col("part") == "queued", F.col("priority")), F.when(F.col("part") == "queued", F.col("created")),
        F.when(F.col("part") == "running", F.col("started")).desc_nulls_last(), F.when(F.col("part") == "recent", F.col("finished")).desc_nulls_last(), F.col("run_id"),
    ]
    keyed = runs.withColumn("part", group)
    return keyed.withColumn("place", F.row_number().over(part.orderBy(*order))).where(F.col("place") <= n)


def retire_stale(runs: DataFrame, now: Column, silent: int = 120, most: int = 3) -> DataFrame:
    """Running runs without a beat for ``silent`` seconds, with what becomes of them."""
    quiet = F.col("heartbeat").isNull() | (F.col("heartbeat") < now - F.make_interval(secs=F.lit(silent)))
    outcome = F.when((F.col("attempts") >= most) | (F.col("stage") == "swap"), "retired").otherwise("requeued")
    return runs.where((F.col("state") == "running") & quiet).withColumn("outcome", outcome)


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of each run's log ``lines`` (run_id, line_id, ts, ...), with ``nth`` from 1 in order of (ts, line_id)."""
    run = Window.partitionBy("run_id")
    back = lines.withColumn("_back", F.row_number().over(run.orderBy(F.desc("ts"), F.desc("line_id")))).where(F.col("_back") <= n)
    return back.withColumn("nth", F.row_number().over(run.orderBy("ts", "line_id"))).drop("_back")


def newest_kept_backup(backups: DataFrame) -> DataFrame:
    """(item_id, backup_id, path): what an audit of an item reads, the newest of its kept backups (backup_id, item_id, state, path, created) that is no subtitle file. Items without one have no row."""
    kept = backups.where((F.col("state") == "kept") & ~F.lower("path").endswith(".srt"))
    # A backup without a time is older than any.
    newest = kept.groupBy("item_id").agg(F.max(F.struct(F.col("created").isNotNull().alias("told"), "created", "backup_id", "path")).alias("b"))
    return newest.select("item_id", "b.backup_id", "b.path")


def clips(detections: DataFrame, most: int = 300) -> DataFrame:
    """``detections`` (run_id, idx, start) with ``clip``: whether a clip is cut, for the first ``most`` of each run in order of start; the rest is told, not dropped."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("start", "idx"))
    return detections.withColumn("clip", nth <= most)
