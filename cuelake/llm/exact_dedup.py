"""Exact dedup by a tree-merge of sorted digest runs.

Documents are dealt into ``RUNS`` runs by a hash of their id. A run is a list of (digest, length)
sorted and without repeats, each with the surviving id and the number of rows it stands for. In
binomial rounds run ``2k`` takes in run ``2k + 1``: both arrive in one sorted stream, and equal
neighbours fold into one entry, the surviving id of the two being kept. After log2(RUNS) rounds one
run is left, still spread over the cluster by digest lane. Repeated digests then walk back to the
runs they came from, so that even a digest of a third of all rows is joined in RUNS separate pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialise, shuffle_partitions

RUNS = 64
_ENTRY = "run int, digest binary, n_bytes int, keep long, copies long"


def _fold(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Fold equal neighbours of a stream sorted by (run, digest, n_bytes); only one entry is held back."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        folded = table.group_by(["run", "digest", "n_bytes"], use_threads=False).aggregate(
            [("keep", "max" if largest else "min"), ("copies", "sum")]
        )
        folded = folded.select(["run", "digest", "n_bytes", "keep_max" if largest else "keep_min", "copies_sum"])
        folded = folded.rename_columns(["run", "digest", "n_bytes", "keep", "copies"]).cast(
            pa.schema([("run", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int32()), ("keep", pa.int64()), ("copies", pa.int64())])
        )
        held = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merge_round(runs: DataFrame, largest: bool) -> DataFrame:
    """One binomial round: pairs of neighbouring runs meet, lane by lane, and fold into one."""
    parts = shuffle_partitions(runs.sparkSession)
    met = runs.withColumn("run", F.expr("int(run div 2)")).withColumn("lane", F.substring("digest", 1, 2))
    met = met.repartition(parts, "run", "lane").drop("lane").sortWithinPartitions("run", "digest", "n_bytes")
    return met.mapInArrow(lambda batches: _fold(batches, largest), _ENTRY)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, digest (SHA-256 of the text), n_bytes, keep_id, group_size.

    Null text counts as empty. Texts are equal when their bytes are. ``keep`` is "max" or "min": which
    id of a group survives. Rows that repeat an id count as further copies. Null ids take part in
    ``group_size`` but never survive (a group of null ids only has a null keep_id). An empty table gives
    no rows.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_digest(F.col(text_col)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
    ).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(RUNS)).cast("int"))
    base = materialise(base, "digests")
    pick = F.max if keep == "max" else F.min
    leaves = base.groupBy("run", "digest", "n_bytes").agg(pick("id").alias("keep"), F.count("*").alias("copies"))
    leaves = materialise(leaves, "runs")
    merged = leaves
    for _ in range((RUNS - 1).bit_length()):
        merged = _merge_round(merged, keep == "max")
    repeated = merged.where("copies > 1").drop("run")
    # Back down: the runs that hold a repeated digest, then the rows of those runs.
    spread = leaves.select("run", "digest", "n_bytes").join(repeated, ["digest", "n_bytes"])
    spread = materialise(spread, "spread")
    rows = base.join(spread, ["run", "digest", "n_bytes"], "left")
    return rows.select(
        "id", "digest", "n_bytes",
        F.when(F.col("copies").isNotNull(), F.col("keep")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the surviving id stays, columns as they were, whatever their names.

    Of rows that repeat the surviving id with the same text one stays. A row is known by its id and the digest
    of its text, so other texts of the same id, or of rows without one, are not touched.
    """
    plain = by_place(docs)
    own_id, text = (plain.columns[docs.columns.index(c)] for c in (id_col, text_col))
    groups = digest_groups(plain, own_id, text, keep).where("group_size > 1")
    key = ["id", "digest", "n_bytes"]
    drop = groups.groupBy(*key).agg(F.max(F.col("id").eqNullSafe(F.col("keep_id"))).alias("stays"), F.count("*").alias("rows"))
    drop = materialise(drop, "drop")
    gone = drop.where("not stays").select(F.col("id").alias("_gone"), F.col("digest").alias("_gone_digest"))
    digest = text_digest(F.col(text))
    marked = plain.join(gone, F.col(own_id).cast("long").eqNullSafe(F.col("_gone")) & (digest == F.col("_gone_digest")), "left_anti")
    if drop.where("stays and rows > 1").limit(1).count():
        marked = marked.withColumn("_digest", digest).dropDuplicates([own_id, "_digest"]).drop("_digest")
    return marked.toDF(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = digest_groups(docs)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
