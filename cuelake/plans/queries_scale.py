"""Queries on histories of items and medians of groups of any size, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import medians, runs
from ..streaming import handling
from . import fixtures as fx
from .queries_more import _pick

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_KINDS = ("Download", "RunStarted", "BackupKept", "Rename", "RunEnded", "Download", "RunStarted", "EpisodeFileDelete", "SeriesDelete", "SeriesAdd", "RunEnded")


def item_events(spark, d):
    e = F.col("event_id")
    kind = _pick(_KINDS, (e * 7 + F.col("user_id")) % 11)
    return fx.table(spark, d, "events").select(
        F.col("user_id").alias("item_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), kind.alias("event_type"), F.when(e % 4 > 0, F.concat(F.lit("/f/"), e.cast("string"))).alias("path"),
        F.concat(F.lit("r"), (e % 2).cast("string")).alias("run_id"), (e % 3 == 0).alias("upgrade"), F.col("ts").cast("timestamp").alias("ts"),
    )


@add("item_history", f"""
WITH RECURSIVE e AS (
  SELECT user_id AS item_id, ['{"', '".join(_KINDS)}'][(event_id * 7 + user_id) % 11 + 1] AS t, CASE WHEN event_id % 4 > 0 THEN '/f/' || event_id END AS p, 'r' || event_id % 2 AS run, event_id % 3 = 0 AS up,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), s(item_id, k, path, status, disabled, unskipped, live_run, cancelled, kept, orphaned, renames) AS (
  SELECT DISTINCT item_id, 0::BIGINT, NULL::VARCHAR, 'unknown', false, false, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e
  UNION ALL SELECT s.item_id, e.k, CASE WHEN t IN ('Download', 'Rename') THEN coalesce(p, path) ELSE path END, CASE t WHEN 'Download' THEN 'pending' WHEN 'EpisodeFileDelete' THEN 'stale' ELSE status END,
   CASE t WHEN 'SeriesDelete' THEN true WHEN 'SeriesAdd' THEN false ELSE disabled END, unskipped OR t = 'Download',
   CASE WHEN t = 'RunStarted' THEN run WHEN t = 'RunEnded' AND run = live_run THEN NULL WHEN t = 'Download' AND up THEN NULL ELSE live_run END,
   cancelled + CASE WHEN t = 'Download' AND up AND live_run IS NOT NULL THEN 1 ELSE 0 END,
   CASE WHEN t = 'BackupKept' THEN kept + 1 WHEN t = 'EpisodeFileDelete' OR (t = 'Download' AND up) THEN 0 ELSE kept END,
   orphaned + CASE WHEN t = 'EpisodeFileDelete' OR (t = 'Download' AND up) THEN kept ELSE 0 END, renames + CASE WHEN t = 'Rename' THEN 1 ELSE 0 END
  FROM s JOIN e ON e.item_id = s.item_id AND e.k = s.k + 1
) SELECT item_id, path, status, disabled, unskipped, live_run, cancelled, kept AS backups_kept, orphaned AS backups_orphaned, renames, k AS n_events FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1""")
def _(spark, d):
    return handling.item_history(item_events(spark, d))


@add("price_medians", "SELECT l_returnflag AS flag, l_linestatus AS status, median(l_extendedprice)::DOUBLE AS price FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', NULL, median(l_extendedprice)::DOUBLE FROM lineitem")
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").cast("double").alias("price"))
    every = medians.exact_medians(rows, [], "price", "price").select(F.lit("all"), F.lit(None).cast("string"), "price")
    return medians.exact_medians(rows, ["flag", "status"], "price", "price").union(every)


@add("newest_backups", f"SELECT item_id, backup_id, path FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY purge_after DESC NULLS LAST, backup_id DESC) AS k FROM (SELECT * REPLACE (path || CASE WHEN is_subtitle THEN '.SRT' ELSE '' END AS path) FROM {fx.BACKUPS_SQL}) WHERE state = 'kept' AND NOT is_subtitle) WHERE k = 1")
def _(spark, d):
    b = fx.backups(spark, d).withColumn("created", F.col("purge_after")).withColumn("path", F.concat("path", F.when(F.col("is_subtitle"), ".SRT").otherwise("")))
    return runs.newest_kept_backup(b)


@add("capped_clips", "SELECT l_orderkey AS run_id, l_linenumber AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) <= 3 AS clip FROM lineitem")
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("start"))
    return runs.clips(rows, 3).select("run_id", "idx", "clip")
