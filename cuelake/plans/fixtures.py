"""Projections of the given tables onto the library's schemas, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded_lists
from ..stores import spread

#: Test word list: canonical, category, forms, is_phrase, enabled.
LEXICON = [
    ("rewh", "strong", ["rewh", "orre"], False, True),
    ("thatin", "strong", ["thatin"], False, True),
    ("ononst", "mild", ["ononst"], False, True),
    ("inoran", "mild", ["inoran"], False, True),
    ("of the", "religious", ["of the"], True, True),
    ("hehely", "slurs", ["hehely"], False, True),
    ("orantion", "sexual", ["orantion"], False, False),
]
NEVER = ["the", "and"]
SQL_FORMS = "(VALUES " + ", ".join(f"('{f}', '{c}', '{g}')" for c, g, fs, p, e in LEXICON if e and not p for f in fs) + ") AS lx(form, canonical, category)"
#: What Java's Unicode \w leaves out, and its Unicode white space, for the SQL.
NO_WORD = "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+"
SPACE = "[\\s\\x0B\\x{85}\\p{Z}]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    # Of each text hundreds of rows are made.
    return spread(rows) if name == "documents" else rows


def cues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("cue_index"), (F.col("turn") * 12000).alias("start_ms"),
        (F.col("turn") * 12000 + F.least(F.lit(10000), 60 * F.length("text"))).alias("end_ms"), "text",
    )


CUES_SQL = "(SELECT conv_id AS item_id, turn AS cue_index, turn * 12000 AS start_ms, turn * 12000 + least(10000, 60 * length(text)) AS end_ms, text FROM conversations)"


def words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", r"(?U)\s+")).alias("word_index", "word"))
    return rows.withColumns({
        "start_ms": F.col("word_index").cast("long") * 400, "end_ms": F.col("word_index").cast("long") * 400 + 300,
        "probability": ((F.col("item_id") * 31 + F.col("word_index") * 17) % 100) / 100,
    })


def word_lists(spark: SparkSession, d: str) -> DataFrame:
    """The words of each document that has a text, as one array."""
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), F.split("text", r"(?U)\s+").alias("words"))


def timed(rows: DataFrame, lists: Column, name: str) -> DataFrame:
    """Arrays of words of each item_id as the rows of ``words``."""
    return clocked(rows.select("item_id", F.posexplode(lists).alias("word_index", name)))


def clocked(said: DataFrame) -> DataFrame:
    """Words with the times that ``words`` gives them by their place."""
    return said.withColumns({"start_ms": F.col("word_index").cast("long") * 400, "end_ms": F.col("word_index").cast("long") * 400 + 300})


def said(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Of ``words``, without their outer punctuation and folded, those that are in ``names``. Lists are folded, each distinct word of a batch once."""
    return timed(word_lists(spark, d), folded_lists(F.col("words")), "word").where(F.col("word").isin(names))


WORDS_SQL = (
    "(SELECT doc_id AS item_id, i - 1 AS word_index, ws[i] AS word, (i - 1) * 400 AS start_ms, (i - 1) * 400 + 300 AS end_ms, ((doc_id * 31 + (i - 1) * 17) % 100) / 100 AS probability "
    f"FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{SPACE}') AS ws FROM documents)))"
)


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Events as ranges in microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("user_id").alias("item_id"), at.alias("start"), (at + F.floor(F.abs("value") * 10_000_000)).alias("end"), "event_id")


RANGES_SQL = "(SELECT user_id AS item_id, epoch_us(ts) AS \"start\", epoch_us(ts) + CAST(floor(abs(value) * 10000000) AS BIGINT) AS \"end\", event_id FROM events)"
HOUR = 3_600_000_000

TYPES = {"signup": "SeriesAdd", "view": "Download", "click": "Rename", "error": "EpisodeFileDelete", "purchase": "Test"}


def catalog_events(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("item_id"), F.try_element_at(names, F.col("event_type")).alias("event_type"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("ts").cast("timestamp").alias("ts"), "props",
    )


EVENTS_SQL = "(SELECT event_id, user_id AS item_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END AS event_type, epoch_us(ts) AS at_us, props FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("already_clean")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("item_id"), state.alias("state"), (F.col("o_orderkey") % 5 == 0).alias("dry_run"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("created"), (F.col("o_orderkey") % 7).alias("fingerprint"),
    )


RUNS_SQL = (
    "(SELECT o_orderkey AS run_id, o_custkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'already_clean' END AS state, "
    "o_orderkey % 5 = 0 AS dry_run, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate::TIMESTAMP AS created, o_orderkey % 7 AS fingerprint FROM orders)"
)


def items(spark: SparkSession, d: str) -> DataFrame:
    """Customers as items of their nation; the last run is the newest order."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_run_id"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "clean").when(F.col("c_mktsegment") == "MACHINERY", "failed").when(F.col("c_mktsegment") == "HOUSEHOLD", "stale").otherwise("pending")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("title_id"), F.col("c_name").alias("name"), status.alias("status"),
        (F.col("c_custkey") % 4 == 0).alias("skip"), (F.col("c_custkey") % 9 != 0).alias("enabled"), (F.col("c_custkey") % 7).alias("fingerprint"),
    )
    return rows.join(last, "item_id", "left")


ITEMS_SQL = (
    "(SELECT c_custkey AS item_id, c_nationkey AS title_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'clean' WHEN 'MACHINERY' THEN 'failed' WHEN 'HOUSEHOLD' THEN 'stale' ELSE 'pending' END AS status, "
    "c_custkey % 4 = 0 AS skip, c_custkey % 9 <> 0 AS enabled, c_custkey % 7 AS fingerprint, l.last_run_id FROM customer LEFT JOIN "
    "(SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_run_id FROM orders GROUP BY 1) l ON l.o_custkey = c_custkey)"
)


def detections(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("l_linenumber") % 3 == 0, "both").when(F.col("l_linenumber") % 3 == 1, "subtitle").otherwise("stt")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("canonical"), F.col("l_linestatus").alias("category"),
        (F.col("l_discount") >= 0.03).alias("muted"), (F.col("l_tax") >= 0.07).alias("whitelisted"), (F.col("l_quantity") > 45).alias("suspicious"), source.alias("source"),
    )


DETECTIONS_SQL = (
    "(SELECT l_orderkey AS run_id, l_linenumber AS idx, l_returnflag AS canonical, l_linestatus AS category, l_discount >= 0.03 AS muted, l_tax >= 0.07 AS whitelisted, "
    "l_quantity > 45 AS suspicious, CASE l_linenumber % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'subtitle' ELSE 'stt' END AS source FROM lineitem)"
)


def backups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("backup_id"), (k % 50).alias("item_id"), F.col("p_size").cast("long").alias("size"), F.element_at(F.array(*[F.lit(s) for s in ("kept", "orphaned", "purged", "restored")]), (k % 4 + 1).cast("int")).alias("state"),
        F.when(k % 7 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (k % 60).cast("int"))).alias("purge_after"), (k % 5 == 0).alias("is_subtitle"), F.when(k % 3 == 0, "clean").otherwise("failed").alias("item_status"),
        F.concat(F.when(k % 10 == 0, "/other/").otherwise("/backup/"), k.cast("string")).alias("path"),
    )


BACKUPS_SQL = (
    "(SELECT p_partkey AS backup_id, p_partkey % 50 AS item_id, p_size::BIGINT AS size, ['kept', 'orphaned', 'purged', 'restored'][p_partkey % 4 + 1] AS state, "
    "CASE WHEN p_partkey % 7 <> 0 THEN DATE '2001-01-01' + CAST(p_partkey % 60 AS INT) END AS purge_after, p_partkey % 5 = 0 AS is_subtitle, CASE WHEN p_partkey % 3 = 0 THEN 'clean' ELSE 'failed' END AS item_status, "
    "CASE WHEN p_partkey % 10 = 0 THEN '/other/' ELSE '/backup/' END || p_partkey AS path FROM part)"
)
