"""Queries on runs, items, catalogue and events, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import catalog, runs, scoring
from ..streaming import events as ev
from . import fixtures as fx

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_EVIDENCE = f"""(WITH r AS (SELECT * FROM {fx.RUNS_SQL} WHERE state IN ('done', 'failed', 'stale') AND NOT dry_run)
SELECT i.item_id, i.title_id, CASE WHEN l.run_id IS NOT NULL THEN i.last_run_id ELSE coalesce(n.newest, i.last_run_id) END AS evidence_run_id
FROM {fx.ITEMS_SQL} i LEFT JOIN r l ON l.run_id = i.last_run_id AND l.item_id = i.item_id LEFT JOIN (SELECT item_id, max_by(run_id, (created, run_id)) AS newest FROM r GROUP BY 1) n ON n.item_id = i.item_id)"""


@add("evidence_run", f"SELECT item_id, evidence_run_id FROM {_EVIDENCE}")
def _(spark, d):
    return runs.evidence_run(fx.items(spark, d), fx.runs(spark, d))


@add("latest_per_item", f"SELECT item_id, max_by(run_id, (created, run_id)) AS run_id FROM {fx.RUNS_SQL} GROUP BY 1")
def _(spark, d):
    return runs.latest_per_item(fx.runs(spark, d), F.desc("created"), F.desc("run_id")).select("item_id", "run_id")


_COUNTS = "count(*) AS total, count(*) FILTER (muted AND NOT whitelisted) AS muted, count(*) FILTER (suspicious) AS suspicious"


@add("word_counts", f"SELECT canonical, category, {_COUNTS} FROM {fx.DETECTIONS_SQL} GROUP BY ALL")
def _(spark, d):
    return runs.word_counts(fx.detections(spark, d))


@add("item_word_counts", f"SELECT run_id, canonical, category, {_COUNTS} FROM {fx.DETECTIONS_SQL} WHERE NOT whitelisted GROUP BY ALL")
def _(spark, d):
    return runs.word_counts(fx.detections(spark, d).where("not whitelisted"), "run_id")


@add("word_sources", f"SELECT canonical, count(*) FILTER (source = 'both') AS both_n, count(*) FILTER (source = 'stt') AS stt_n FROM {fx.DETECTIONS_SQL} GROUP BY 1")
def _(spark, d):
    return runs.word_sources(fx.detections(spark, d)).select("canonical", F.col("by_source")["both"].alias("both_n"), F.col("by_source")["stt"].alias("stt_n"))


@add("title_rollup", f"SELECT e.title_id, canonical, category, {_COUNTS} FROM {fx.DETECTIONS_SQL} x JOIN {_EVIDENCE} e ON e.evidence_run_id = x.run_id WHERE NOT whitelisted GROUP BY ALL")
def _(spark, d):
    return runs.title_rollup(fx.items(spark, d), fx.runs(spark, d), fx.detections(spark, d))


@add("title_status_counts", f"""
SELECT n_nationkey AS title_id, count(item_id) AS items, count(*) FILTER (status IN ('clean', 'already_clean')) AS clean, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IN ('pending', 'failed') AND skip) AS deferred FROM nation LEFT JOIN {fx.ITEMS_SQL} i ON i.title_id = n_nationkey GROUP BY 1""")
def _(spark, d):
    return runs.title_status_counts(fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("title_id")), fx.items(spark, d))


@add("run_stats", f"SELECT run_id, count(*) AS detections, count(*) FILTER (muted) AS muted, count(*) FILTER (suspicious) AS suspicious, count(*) FILTER (whitelisted) AS whitelisted, count(*) FILTER (source = 'both') AS from_both, count(*) FILTER (source = 'subtitle') AS from_subtitle, count(*) FILTER (source = 'stt') AS from_stt FROM {fx.DETECTIONS_SQL} GROUP BY 1")
def _(spark, d):
    return runs.run_stats(fx.detections(spark, d), ["both", "subtitle", "stt"])


_DUE = "purge_after <= DATE '2001-02-01' AND state IN ('kept', 'orphaned')"


@add("backup_summary", f"SELECT state, count(*) AS n, sum(size)::BIGINT AS bytes, count(*) FILTER ({_DUE}) AS expired, count(*) FILTER (purge_after IS NULL AND state = 'kept') AS keeps_forever FROM {fx.BACKUPS_SQL} GROUP BY 1")
def _(spark, d):
    return runs.backup_summary(fx.backups(spark, d), F.lit("2001-02-01").cast("date"))


@add("last_original", f"""
SELECT backup_id, state = 'kept' AND NOT is_subtitle AND item_status = 'clean' AND count(*) FILTER (state = 'kept' AND NOT is_subtitle) OVER (PARTITION BY item_id) = 1 AS last_original FROM {fx.BACKUPS_SQL}""")
def _(spark, d):
    return runs.last_original(fx.backups(spark, d)).select("backup_id", "last_original")


@add("purge_candidates", f"SELECT backup_id, CASE WHEN starts_with(path, '/backup/') THEN 'purge' ELSE 'refused' END AS outcome FROM {fx.BACKUPS_SQL} WHERE state = 'orphaned' OR ({_DUE})")
def _(spark, d):
    return catalog.purge_candidates(fx.backups(spark, d), F.lit("2001-02-01").cast("date"), "/backup/")


@add("list_backups", f"SELECT backup_id, size FROM {fx.BACKUPS_SQL} ORDER BY size DESC NULLS LAST, backup_id LIMIT 20")
def _(spark, d):
    return fx.backups(spark, d).orderBy(F.desc_nulls_last("size"), "backup_id").limit(20).select("backup_id", "size")


@add("queue_view", f"SELECT part, place, run_id FROM (SELECT run_id, CASE state WHEN 'queued' THEN 'queued' ELSE 'recent' END AS part, row_number() OVER (PARTITION BY CASE state WHEN 'queued' THEN 'queued' ELSE 'recent' END ORDER BY CASE WHEN state = 'queued' THEN priority END, CASE WHEN state = 'queued' THEN created END, CASE WHEN state <> 'queued' THEN created END DESC NULLS LAST, run_id) AS place FROM {fx.RUNS_SQL}) WHERE place <= 25")
def _(spark, d):
    table = fx.runs(spark, d).withColumn("started", F.col("created")).withColumn("finished", F.col("created"))
    return runs.queue_view(table, 25).select("part", F.col("place").cast("long").alias("place"), "run_id")


@add("runnable_order", f"SELECT run_id FROM {fx.RUNS_SQL} WHERE state = 'queued' AND (run_id % 3 > 0 OR created <= TIMESTAMP '1995-01-01') ORDER BY priority, created, run_id LIMIT 50")
def _(spark, d):
    retry = F.when(F.col("run_id") % 3 == 0, F.col("created"))
    return runs.runnable(fx.runs(spark, d).withColumn("retry_at", retry), F.lit("1995-01-01").cast("timestamp")).limit(50).select("run_id")


@add("catalogue_total", "SELECT count(*) AS total FROM customer WHERE c_name ILIKE '%0%'")
def _(spark, d):
    return runs.page(fx.items(spark, d).where(F.col("name").ilike("%0%")), [F.lower("name"), "item_id"], 20, 40)[1]


@add("queued_total", f"SELECT count(*) FILTER (state = 'queued') AS queued FROM {fx.RUNS_SQL}")
def _(spark, d):
    return runs.queued_total(fx.runs(spark, d))


@add("muted_runs", "SELECT l_orderkey AS run_id, count(*) AS ranges, CAST(sum(l_quantity) AS BIGINT) AS muted_for FROM lineitem GROUP BY 1")
def _(spark, d):
    spans = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"))
    return runs.run_stats(fx.detections(spark, d), ["stt"], spans).select("run_id", "ranges", "muted_for")


@add("catalogue_page", "SELECT c_custkey AS item_id, c_name AS name FROM customer WHERE c_name ILIKE '%0%' ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return runs.page(fx.items(spark, d).where(F.col("name").ilike("%0%")), [F.lower("name"), "item_id"], 20, 40)[0].select("item_id", "name")


@add("item_status", f"SELECT run_id, CASE WHEN state = 'already_clean' THEN state WHEN dry_run THEN 'pending' WHEN state = 'done' THEN 'clean' ELSE 'pending' END AS status FROM {fx.RUNS_SQL}")
def _(spark, d):
    return fx.runs(spark, d).select("run_id", rules.item_status(F.col("state"), F.col("dry_run")).alias("status"))


#: Every stage, error, number of attempts and place of the source, one of them to each run.
_STAGES, _ERRORS, _PLACES = ("probe", "transcribe", "render", "verify", "swap", "refresh", "snippets"), ("other", "stale_source", "swap_broken", "stale_source", "timeout"), ("moved", "gone", "unchanged", "unavailable", None)


@add("retry_plan", f"""
WITH f AS (SELECT run_id, ['probe', 'transcribe', 'render', 'verify', 'swap', 'refresh', 'snippets'][run_id % 7 + 1] AS stage, ['other', 'stale_source', 'swap_broken', 'stale_source', 'timeout'][run_id // 7 % 5 + 1] AS error,
 1 + run_id // 35 % 4 AS n, ['moved', 'gone', 'unchanged', 'unavailable', NULL][run_id // 140 % 5 + 1] AS place FROM {fx.RUNS_SQL}),
lost(place, first, state, delay) AS (VALUES ('moved', true, 'queued', 5.0), ('moved', false, 'queued', 5.0), ('gone', true, 'stale', NULL), ('gone', false, 'stale', NULL), ('unchanged', true, 'stale', NULL),
 ('unchanged', false, 'stale', NULL), ('unknown', true, 'queued', 60.0), ('unknown', false, 'stale', NULL)),
ends(stage, verdict, state) AS (VALUES ('render', 'terminal', 'failed'), ('verify', 'terminal', 'failed'), ('swap', 'terminal', 'failed'), ('refresh', 'best_effort', 'done'), ('snippets', 'best_effort', 'done'))
SELECT run_id, 'terminal' AS verdict, 'failed' AS state, NULL::DOUBLE AS delay FROM f WHERE error = 'swap_broken'
UNION ALL SELECT run_id, 'stale', state, delay::DOUBLE FROM f JOIN lost ON lost.first = (n = 1) AND lost.place = CASE WHEN f.place IN ('moved', 'gone', 'unchanged') THEN f.place ELSE 'unknown' END WHERE error = 'stale_source'
UNION ALL SELECT run_id, coalesce(e.verdict, if(n > 2, 'terminal', 'retry')), coalesce(e.state, if(n > 2, 'failed', 'queued')), CASE WHEN e.verdict IS NULL AND n < 3 THEN [60.0, 300.0][n] END::DOUBLE
 FROM f LEFT JOIN ends e USING (stage) WHERE error IN ('other', 'timeout')""")
def _(spark, d):
    k, pick = F.col("run_id"), lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    plan = rules.retry_plan(pick(_STAGES, k % 7), pick(_ERRORS, F.floor(k / 7) % 5), (1 + F.floor(k / 35) % 4).cast("int"), pick(_PLACES, F.floor(k / 140) % 5))
    return fx.runs(spark, d).select("run_id", plan.alias("p")).select("run_id", "p.verdict", "p.state", "p.delay")


@add("queue_rows", f"SELECT r.run_id, i.name, n_name AS title FROM {fx.RUNS_SQL} r JOIN {fx.ITEMS_SQL} i USING (item_id) LEFT JOIN nation ON n_nationkey = i.title_id WHERE r.state = 'queued'")
def _(spark, d):
    q = fx.runs(spark, d).where("state = 'queued'").select("run_id", "item_id").join(fx.items(spark, d).select("item_id", "name", "title_id"), "item_id")
    return q.join(fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("title_id"), F.col("n_name").alias("title")), "title_id", "left").select("run_id", "name", "title")


@add("needs_cleaning", f"""
WITH f AS (SELECT item_id, fingerprint, count(*) AS n FROM {fx.RUNS_SQL} WHERE state = 'already_clean' GROUP BY ALL)
SELECT i.item_id FROM {fx.ITEMS_SQL} i LEFT JOIN f ON f.item_id = i.item_id AND f.fingerprint = i.fingerprint LEFT JOIN {fx.RUNS_SQL} r ON r.run_id = i.last_run_id
WHERE i.enabled AND i.status <> 'stale' AND NOT i.skip AND CASE WHEN i.status = 'clean' THEN i.fingerprint IS DISTINCT FROM r.fingerprint ELSE coalesce(f.n, 0) < 2 END""")
def _(spark, d):
    r = fx.runs(spark, d).withColumn("state", F.when(F.col("state") == "already_clean", "failed").otherwise(F.col("state")))
    return catalog.needs_cleaning(fx.items(spark, d), r)


@add("upsert_titles", "SELECT coalesce(o.k, n.k) AS remote_id, coalesce(n.t, o.t) AS title, coalesce(o.e, false) AS enabled FROM (SELECT c_custkey AS k, c_name AS t, c_custkey % 2 = 0 AS e FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) || '!' END AS t FROM customer WHERE c_custkey % 4 <> 0) n ON n.k = o.k")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("remote_id"), F.col("c_name").alias("title"))
    old = c.where("remote_id % 3 != 0").withColumn("enabled", F.col("remote_id") % 2 == 0)
    new = c.where("remote_id % 4 != 0").withColumn("title", F.when(F.col("remote_id") % 5 != 0, F.concat(F.upper("title"), F.lit("!"))))
    return catalog.upsert(old, new, ["remote_id"], ["title"], {"enabled": F.lit(False)})


@add("missing_titles", "SELECT c_custkey AS remote_id FROM customer WHERE c_custkey % 7 = 0")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("remote_id"))
    return catalog.missing(c, c.where("remote_id % 7 != 0"), "remote_id")


@add("reconcile_listing", f"""
WITH b AS {fx.BACKUPS_SQL}, f AS (SELECT CASE backup_id % 11 WHEN 0 THEN '/backup/.' || backup_id WHEN 1 THEN '/backup/x' || backup_id || '/README.txt' ELSE path END AS path, backup_id FROM b WHERE backup_id % 3 <> 0 UNION ALL SELECT '/backup/README.txt', NULL),
k AS (SELECT path, state FROM b WHERE backup_id % 9 <> 0)
SELECT path, 'adopted' AS outcome FROM f WHERE coalesce(backup_id % 11, 0) <> 0 AND path NOT IN (SELECT path FROM k)
UNION ALL SELECT path, CASE WHEN path IN (SELECT path FROM f) THEN 'same' ELSE 'purged' END FROM k WHERE path IN (SELECT path FROM f) OR state IN ('kept', 'orphaned')""")
def _(spark, d):
    b = fx.backups(spark, d)
    k = F.col("backup_id")
    path = F.when(k % 11 == 0, F.concat(F.lit("/backup/."), k.cast("string"))).when(k % 11 == 1, F.concat(F.lit("/backup/x"), k.cast("string"), F.lit("/README.txt"))).otherwise(F.col("path"))
    files = b.where("backup_id % 3 != 0").select(path.alias("path")).union(spark.createDataFrame([("/backup/README.txt",)], "path string"))
    return catalog.reconcile_listing(files, b.where("backup_id % 9 != 0"), root="/backup")


@add("group_episode_files", "SELECT file_id, min((s, e))[1] AS season, min((s, e))[2] AS episode, string_agg(t, ' + ' ORDER BY s, e, t) AS title FROM (SELECT l_orderkey AS file_id, l_linenumber % 2 + 1 AS s, l_linenumber AS e, l_returnflag || l_linestatus AS t FROM lineitem) GROUP BY 1")
def _(spark, d):
    e = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 2 + 1).alias("season"), F.col("l_linenumber").alias("episode"), F.concat("l_returnflag", "l_linestatus").alias("title"))
    return catalog.group_episode_files(e).select("file_id", "season", "episode", "title")


@add("mapping_mismatch", f"SELECT backup_id AS item_id, CASE WHEN backup_id % 5 = 0 THEN 'missing' WHEN backup_id % 3 = 0 THEN 'path' WHEN backup_id % 2 = 0 AND backup_id % 7 > 0 THEN 'size' END AS reason FROM {fx.BACKUPS_SQL} WHERE backup_id % 5 = 0 OR backup_id % 3 = 0 OR (backup_id % 2 = 0 AND backup_id % 7 > 0)")
def _(spark, d):
    b = fx.backups(spark, d).select(F.col("backup_id").alias("item_id"), "path", "size")
    remote = b.where("item_id % 5 != 0").withColumn("path", F.when(F.col("item_id") % 3 == 0, "elsewhere").otherwise(F.col("path"))).withColumn("size", F.when(F.col("item_id") % 7 == 0, 0).when(F.col("item_id") % 2 == 0, -1).otherwise(F.col("size")))
    return catalog.mapping_mismatch(b, remote)


@add("mapping_conflicts", "SELECT app, 'from_prefix' AS side, p AS prefix FROM (SELECT n_regionkey AS app, substr(n_name, 1, 1) AS p FROM nation) GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT app, 'to_prefix', p FROM (SELECT n_regionkey AS app, substr(n_name, 2, 1) AS p FROM nation) GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_regionkey").alias("app"), F.substring("n_name", 1, 1).alias("from_prefix"), F.substring("n_name", 2, 1).alias("to_prefix"))
    return catalog.mapping_conflicts(n)


_PATH = r"regexp_replace(url, '[/\\]+$', '')"


@add("map_paths", f"SELECT page_id, CASE WHEN p = 'https://m' THEN 'x' WHEN starts_with(p, 'https://m/') THEN 'x' || substr(p, 10) WHEN p = 'https:' OR starts_with(p, 'https:/') THEN 's3:' || substr(p, 7) WHEN p = 'http:' OR starts_with(p, 'http:/') THEN 'gs:' || substr(p, 6) ELSE p END AS mapped FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def _(spark, d):
    return catalog.map_paths(fx.table(spark, d, "pages"), "url", [("https:", "s3:"), ("http:/", "gs:"), ("https://m", "x")]).select("page_id", "mapped")


@add("change_feed", "SELECT 'p' || (n_nationkey % 5 + 1) AS path, 'Modified' AS change FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'q' || n_nationkey, 'Created' FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'p' || (n_nationkey % 5 + 1), 'Deleted' FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, d):
    n = fx.table(spark, d, "nation")
    old = F.concat(F.lit("p"), (F.col("n_nationkey") % 5 + 1).cast("string"))
    return catalog.change_feed(n.select(old.alias("old_path"), F.when(F.col("n_nationkey") % 2 == 0, old).otherwise(F.concat(F.lit("q"), F.col("n_nationkey").cast("string"))).alias("new_path")))


# Events.
@add("route_events", f"SELECT event_id, CASE event_type WHEN 'SeriesAdd' THEN 'add_title' WHEN 'Test' THEN 'store_only' ELSE CASE WHEN item_id % 3 = 0 THEN 'store_only' WHEN event_type = 'Download' THEN 'download' WHEN event_type = 'Rename' THEN 'rename' ELSE 'file_delete' END END AS action FROM {fx.EVENTS_SQL} WHERE event_type IS NOT NULL")
def _(spark, d):
    e = fx.catalog_events(spark, d).where("event_type is not null").withColumn("title_id", F.col("item_id"))
    return ev.route_events(e, e.where("title_id % 3 != 0").select("title_id").distinct()).select("event_id", "action")


@add("dedupe_events", f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY item_id, event_type ORDER BY at_us, event_id) AS k FROM {fx.EVENTS_SQL}),
r AS (SELECT item_id, event_type, k, event_id, at_us AS last, true AS kept FROM e WHERE k = 1 UNION ALL
SELECT e.item_id, e.event_type, e.k, e.event_id, CASE WHEN e.at_us - r.last > 3600::BIGINT * 1000000 THEN e.at_us ELSE r.last END, e.at_us - r.last > 3600::BIGINT * 1000000 FROM r JOIN e ON e.item_id = r.item_id AND e.event_type IS NOT DISTINCT FROM r.event_type AND e.k = r.k + 1)
SELECT event_id FROM r WHERE kept""")
def _(spark, d):
    return ev.dedupe_events(fx.catalog_events(spark, d), 3600).select("event_id")


@add("item_state", f"""
SELECT item_id, CASE WHEN dl IS NULL AND fd IS NULL THEN 'unknown' WHEN fd IS NULL OR dl > fd THEN 'pending' ELSE 'stale' END AS status, dl IS NOT NULL AS unskipped, false AS disabled, renames, n_events FROM (
SELECT item_id, max((at_us, event_id)) FILTER (event_type = 'Download') AS dl, max((at_us, event_id)) FILTER (event_type = 'EpisodeFileDelete') AS fd, count(*) FILTER (event_type = 'Rename') AS renames, count(*) AS n_events FROM {fx.EVENTS_SQL} GROUP BY 1)""")
def _(spark, d):
    return ev.item_state(fx.catalog_events(spark, d))


@add("session_ranges", f"""
SELECT item_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY item_id ORDER BY "start", "end", event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY item_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {fx.HOUR} THEN 0 ELSE 1 END AS o FROM {fx.RANGES_SQL} WHERE "end" > "start")) GROUP BY item_id, island""")
def _(spark, d):
    r = fx.ranges(spark, d)
    return ev.merge_ranges_stream(r.where("end > start").select("item_id", F.timestamp_micros("start").alias("ts"), (F.col("end") - F.col("start")).alias("dur_us")), fx.HOUR)


@add("stale_heartbeats", f"SELECT item_id AS run_id, max(at_us) AS last_us FROM {fx.EVENTS_SQL} GROUP BY 1 HAVING max(at_us) < (SELECT max(at_us) FROM {fx.EVENTS_SQL}) - 86400::BIGINT * 1000000")
def _(spark, d):
    e = fx.catalog_events(spark, d).select(F.col("item_id").alias("run_id"), "at_us")
    return ev.stale_heartbeats(e, e.agg(F.max("at_us")).first()[0] or 0, 86400)


@add("dedupe_requests", """
WITH RECURSIVE q AS (SELECT o_orderkey AS id, o_custkey AS item, epoch(o_orderdate) + o_orderkey % 3 AS at, o_orderkey % 10 = 0 AS sup, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey % 3, o_orderkey) AS k FROM orders),
r(id, item, k, reason, state, since) AS (
 SELECT id, item, 0::BIGINT, '', state, since FROM (SELECT NULL::BIGINT AS id, c_custkey AS item, CASE c_custkey % 3 WHEN 1 THEN 'queued' WHEN 2 THEN 'running' END AS state, CASE WHEN c_custkey % 3 > 0 THEN epoch(TIMESTAMP '1998-01-01') END AS since FROM customer)
 UNION ALL SELECT q.id, q.item, q.k, CASE WHEN r.state IS NULL THEN 'created' WHEN q.sup THEN 'superseded' WHEN r.state = 'queued' AND q.at - r.since <= 60 THEN 'deduped' ELSE 'already_active' END,
  CASE WHEN r.state IS NULL OR q.sup THEN 'queued' ELSE r.state END, CASE WHEN r.state IS NULL OR q.sup THEN q.at ELSE r.since END FROM r JOIN q ON q.item = r.item AND q.k = r.k + 1)
SELECT id AS request_id, reason FROM r WHERE id IS NOT NULL""")
def _(spark, d):
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 3)
    asked = o.select(k.alias("request_id"), F.col("o_custkey").alias("item_id"), at.alias("at"), (k % 10 == 0).alias("supersede"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    live = c.where("item_id % 3 > 0").select("item_id", F.when(F.col("item_id") % 3 == 1, "queued").otherwise("running").alias("state"), F.lit("1998-01-01").cast("timestamp").alias("created"))
    over = c.select("item_id", F.lit("done"), F.lit("1999-01-01").cast("timestamp"))
    return catalog.dedupe_requests(asked, live.union(over)).select("request_id", "reason")


# Quality.
@add("eval_metrics", """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND h) AS tp, count(*) FILTER (toxic = 0 AND h) AS fp, count(*) FILTER (toxic = 1 AND NOT h) AS fn FROM (SELECT toxic, regexp_matches(lower(text), '(^|\\W)(idiot|moron|stupid)($|\\W)') AS h FROM labels JOIN documents USING (doc_id)))
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM c""")
def _(spark, d):
    x = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents"), "doc_id").select("toxic", F.lower("text").rlike(r"(^|\W)(idiot|moron|stupid)($|\W)").alias("h"))
    c = x.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in (("tp", "toxic = 1 and h"), ("fp", "toxic = 0 and h"), ("fn", "toxic = 1 and not h"))])
    return scoring.eval_metrics(c).select("tp", "fp", "fn", "precision", "recall")


@add("median_run", "SELECT setting, run_no, fp_min, fp_max FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY f1, precision, run_no) - 1 AS k, count(*) OVER (PARTITION BY setting) AS n, min(fp) OVER (PARTITION BY setting) AS fp_min, max(fp) OVER (PARTITION BY setting) AS fp_max FROM (SELECT o_custkey AS setting, o_orderkey AS run_no, o_orderkey % 10 AS f1, o_orderkey % 3 AS precision, o_orderkey % 13 AS fp FROM orders)) WHERE k = n // 2")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return scoring.median_run(o.select(F.col("o_custkey").alias("setting"), k.alias("run_no"), (k % 10).alias("f1"), (k % 3).alias("precision"), (k % 13).alias("fp"))).select("setting", "run_no", "fp_min", "fp_max")


def _spans(spark, d, shift):
    base = fx.ranges(spark, d).where("end > start")
    return base.select("item_id", F.col("event_id").alias("idx"), F.concat(F.lit("w"), (F.col("item_id") % 3).cast("string")).alias("canonical"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.when(F.col("event_id") % 2 == 0, "subtitle").otherwise("stt").alias("source"))


@add("compare_runs")
def _(spark, d):
    prior = _spans(spark, d, 0).withColumns({"mute_start": F.col("start") - 80_000, "mute_end": F.col("end") + 120_000})
    return scoring.compare_runs(prior, _spans(spark, d, 500_000).where("idx % 3 = 0"), 1_000_000, 60_000_000)


@add("score_detections")
def _(spark, d):
    s = _spans(spark, d, 0)
    labels = s.where("idx % 2 = 0").select("item_id", F.col("idx").alias("label_no"), F.col("canonical").alias("word"), "start", "end")
    return scoring.score_detections(labels, _spans(spark, d, 200_000), 500_000, 60_000_000).select("item_id", "label_no", "det_idx", "timing_error")
