"""Handling of event streams: batches applied once, histories of items in event order, runs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import dedupe_events, route_events

#: Events of an item besides those of the catalogue.
FILE_DELETES, TITLE_DELETES, TITLE_ADDS = ("EpisodeFileDelete", "MovieFileDelete"), ("SeriesDelete", "MovieDelete"), ("SeriesAdd", "MovieAdded")
RUN_STARTED, RUN_ENDED, BACKUP_KEPT = "RunStarted", "RunEnded", "BackupKept"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def handled_events(spark: SparkSession, folder: str) -> DataFrame | None:
    """Events that have been handled, each once: those of the batches in the ledger. None: there was no batch yet."""
    if not _exists(spark, f"{folder}/ledger"):
        return None
    ledger = spark.read.parquet(f"{folder}/ledger").select("batch")
    return spark.read.parquet(f"{folder}/handled").join(ledger, "batch", "left_semi")


def handle_batch(batch: DataFrame, number: int, titles: DataFrame, folder: str, seconds: int = 60) -> None:
    """One batch of events (event_id, item_id, title_id, event_type, at_us, any others) into the tables of ``folder``, once.

    The events are stored as they came, then routed; of an item's events of one type those within ``seconds`` of the last kept one, of this or an
    earlier batch, are repeats. A batch's tables lie under its number and are written anew if it comes again; its row in the
    ledger is written last and says that it is done. So a stream that is killed at any moment and started again gives the same tables.
    """
    spark = batch.sparkSession
    before = None
    if _exists(spark, f"{folder}/ledger"):
        ledger = spark.read.parquet(f"{folder}/ledger").where(F.col("batch") < number).select("batch")
        if spark.read.parquet(f"{folder}/ledger").where(F.col("batch") == number).limit(1).count():
            return
        before = spark.read.parquet(f"{folder}/handled").join(ledger, "batch", "left_semi")
    batch.write.mode("overwrite").parquet(f"{folder}/stored/batch={number}")
    stored = spark.read.schema(batch.schema).parquet(f"{folder}/stored/batch={number}")
    fresh = stored.select("event_id", "item_id", "event_type", "at_us")
    if before is not None:
        last = before.where("not repeat").groupBy("item_id", "event_type").agg(F.max("at_us").alias("_last"))
        same = fresh["item_id"].eqNullSafe(last["item_id"]) & fresh["event_type"].eqNullSafe(last["event_type"])
        fresh = fresh.join(last, same & (fresh["at_us"] <= last["_last"] + seconds * 1_000_000), "left_anti")
    kept = dedupe_events(fresh, seconds).select("event_id", F.lit(True).alias("_kept"))
    routed = route_events(stored, titles).join(kept, "event_id", "left").withColumn("repeat", F.col("_kept").isNull()).drop("_kept")
    routed.withColumn("action", F.when(F.col("repeat"), "store_only").otherwise(F.col("action"))).withColumn("handled", F.lit(True)).write.mode("overwrite").parquet(f"{folder}/handled/batch={number}")
    n = spark.read.parquet(f"{folder}/handled/batch={number}").agg(F.count("*").alias("events"), F.count_if("repeat").alias("repeats"))
    n.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")


def handle_events(events: DataFrame, titles: DataFrame, folder: str, checkpoint: str, seconds: int = 60):
    """Start a query that handles a stream of events batch by batch (``handle_batch``)."""
    return events.writeStream.foreachBatch(lambda df, number: handle_batch(df, number, titles, folder, seconds)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HISTORY = "item_id long, path string, status string, disabled boolean, unskipped boolean, live_run string, cancelled long, backups_kept long, backups_orphaned long, renames long, n_events long"


def item_history(events: DataFrame) -> DataFrame:
    """What an item's events (item_id, event_id, at_us, event_type, path, run_id, upgrade) come to in order of at_us and event_id; columns of HISTORY.

    ``path`` is that of the last import or rename that names one. An import makes the item pending and lifts a skip, a deleted file makes it stale. A started run is live
    until it ends, until another one starts, or until an upgrade (an import with ``upgrade``) cancels it. An upgrade and a deleted file make the backups kept so far orphans. A deleted title is disabled until it is added again.
    """
    order, of = F.struct("at_us", "event_id"), lambda *kinds: F.col("event_type").isin(*kinds)
    upgrade = of("Download") & F.coalesce(F.col("upgrade"), F.lit(False))
    rows = events.select("item_id", order.alias("o"), "event_type", "path", "run_id", upgrade.alias("up"))
    last = lambda cond: F.max(F.when(cond, F.col("o")))
    # Runs: where they start, where they end, and the first upgrade after the start.
    turns = rows.where(of(RUN_STARTED, RUN_ENDED) | F.col("up"))
    later = Window.partitionBy("item_id").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.withColumn("upgraded", F.min(F.when(F.col("up"), F.col("o"))).over(later)).where(of(RUN_STARTED))
    starts = starts.withColumn("restarted", F.min("o").over(later)).select("item_id", "run_id", "o", "upgraded", "restarted")
    ends = rows.where(of(RUN_ENDED)).select("item_id", "run_id", F.col("o").alias("e"))
    met = starts.join(ends, ["item_id", "run_id"], "left").groupBy("item_id", "run_id", "o", "upgraded", "restarted").agg(F.min(F.when(F.col("e") > F.col("o"), F.col("e"))).alias("ended"))
    stop = F.least("ended", "restarted")
    cancelled = F.col("upgraded").isNotNull() & (stop.isNull() | (F.col("upgraded") < stop))
    runs = met.groupBy("item_id").agg(F.max(F.when(stop.isNull() & F.col("upgraded").isNull(), F.col("run_id"))).alias("live_run"), F.count_if(cancelled & F.col("run_id").isNotNull()).alias("cancelled"))
    ends_backups = F.col("up") | of(*FILE_DELETES)
    lost = rows.groupBy("item_id").agg(last(ends_backups).alias("lost"))
    backups = rows.where(of(BACKUP_KEPT)).join(lost, "item_id").groupBy("item_id").agg(F.count_if(F.col("lost").isNull() | (F.col("o") > F.col("lost"))).alias("backups_kept"), F.count_if(F.col("o") < F.col("lost")).alias("backups_orphaned"))
    s = rows.groupBy("item_id").agg(
        F.max_by("path", F.when(of("Download", "Rename") & F.col("path").isNotNull(), F.col("o"))).alias("path"), last(of("Download")).alias("dl"), last(of(*FILE_DELETES)).alias("fd"),
        last(of(*TITLE_DELETES)).alias("td"), last(of(*TITLE_ADDS)).alias("ta"), F.count_if(of("Rename")).alias("renames"), F.count("*").alias("n_events"),
    )
    status = F.when(F.col("dl").isNull() & F.col("fd").isNull(), "unknown").when(F.col("fd").isNull() | (F.col("dl") > F.col("fd")), "pending").otherwise("stale")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.join(runs, "item_id", "left").join(backups, "item_id", "left").select(
        "item_id", "path", status.alias("status"), F.coalesce(F.col("td") > F.col("ta"), F.col("td").isNotNull()).alias("disabled"), F.col("dl").isNotNull().alias("unskipped"),
        "live_run", zero("cancelled"), zero("backups_kept"), zero("backups_orphaned"), "renames", "n_events",
    )


class _History(StatefulProcessor):
    """State of an item: events that wait for their turn, where its file is, its run, its backups, and counts. One variable each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, event_id long, event_type string, path string, run_id string, upgrade boolean")
        self.file = handle.getValueState("file", "path string, status string, unskipped boolean, disabled boolean")
        self.run = handle.getValueState("run", "run_id string")
        self.backups = handle.getValueState("backups", "kept long, orphaned long")
        self.counts = handle.getValueState("counts", "cancelled long, renames long, n_events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            columns = [pdf[c] for c in ("at_us", "event_id", "event_type", "path", "run_id", "upgrade")]
            for at, number, kind, path, run, upgrade in zip(*columns):
                text = lambda x: None if pd.isna(x) else str(x)
                self.waiting.appendValue((int(at), int(number), text(kind), text(path), text(run), bool(upgrade) if not pd.isna(upgrade) else False))
                latest = max(latest or 0, int(at) // 1000)
        if latest is not None:
            # The events come to their turn when the watermark has passed them.
            self.handle.registerTimer(latest + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] < now]
        if not due:
            return
        path, status, unskipped, disabled = self.file.get() if self.file.exists() else (None, "unknown", False, False)
        run = self.run.get()[0] if self.run.exists() else None
        kept, orphaned = self.backups.get() if self.backups.exists() else (0, 0)
        cancelled, renames, n = self.counts.get() if self.counts.exists() else (0, 0, 0)
        for _, _, kind, where, run_id, upgrade in due:
            n += 1
            renames += kind == "Rename"
            if kind in ("Download", "Rename") and where is not None:
                path = where
            if kind == "Download":
                status, unskipped = "pending", True
            if kind in FILE_DELETES:
                status = "stale"
            if kind in TITLE_DELETES + TITLE_ADDS:
                disabled = kind in TITLE_DELETES
            if kind == RUN_STARTED:
                run = run_id
            if kind == RUN_ENDED and run == run_id:
                run = None
            if kind == BACKUP_KEPT:
                kept += 1
            if kind == "Download" and upgrade and run is not None:
                run, cancelled = None, cancelled + 1
            if kind in FILE_DELETES or kind == "Download" and upgrade:
                kept, orphaned = 0, orphaned + kept
        later = waiting[len(due) :]
        self.waiting.put(later) if later else self.waiting.clear()
        self.file.update((path, status, bool(unskipped), bool(disabled)))
        self.run.update((run,))
        self.backups.update((kept, orphaned))
        self.counts.update((cancelled, renames, n))
        yield pd.DataFrame(
            {"item_id": [key[0]], "path": [path], "status": [status], "disabled": [bool(disabled)], "unskipped": [bool(unskipped)], "live_run": [run], "cancelled": [cancelled], "backups_kept": [kept], "backups_orphaned": [orphaned], "renames": [renames], "n_events": [n]}
        )

    def close(self) -> None:
        pass


def item_history_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming form of ``item_history`` on events that also have ``ts``: a row of an item each time the watermark lets some of its events come to their turn. Events
    may come in any order, ``late`` at most; they are folded in theirs. Needs the RocksDB state store."""
    keyed = events.withWatermark("ts", late).groupBy("item_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_History(), outputStructType=HISTORY, outputMode="Update", timeMode="EventTime")


class _Silence(StatefulProcessor):
    """The last beat of a run, and a timer for the time when it counts as silent."""

    def __init__(self, silent: int):
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(pdf["at_us"].max()) for pdf in rows if len(pdf))
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or at > before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.last.update((at,))
            self.handle.registerTimer(self._due(at))
        return iter(())

    def _due(self, at: int) -> int:
        return at // 1000 + self.silent * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"run_id": [key[0]], "last_us": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def silent_runs(beats: DataFrame, silent: int = 120, late: str = "0 seconds") -> DataFrame:
    """Streaming form of ``stale_heartbeats``: a run (run_id, at_us, ts of its beats) is told once, when the watermark has passed its last
    beat by ``silent`` seconds, though none of its own comes; a run that beats again is watched anew. Needs the RocksDB state store."""
    kind = beats.schema["run_id"].dataType.simpleString()
    keyed = beats.withWatermark("ts", late).groupBy("run_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Silence(silent), outputStructType=f"run_id {kind}, last_us long", outputMode="Update", timeMode="EventTime")
