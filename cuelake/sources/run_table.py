"""Detections of runs, kept in versions: what a reader sees of a run is always one whole write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chains import numbered
from ..stores import scratch

#: In order of write, unless told otherwise.
ORDER = ("start", "end", "canonical")


def write_run_version(detections: DataFrame, path: str, order: tuple[str, ...] = ORDER, keep: Column | None = None) -> str:
    """Write the detections (run_id and any columns) of some runs as a new version of these runs, and return its name.

    Each detection gets ``idx``, its place in its run by ``order`` from 0. The rows go to a folder of the version's own; then one small file, the manifest, names
    its runs. Until that file is there readers see the version before, and a write that fails leaves it in place. Rows of other runs aren't touched.
    ``keep``: which rows are written; a run of which none is kept becomes an empty one.
    """
    spark, version = detections.sparkSession, f"v{uuid.uuid4().hex}"
    with scratch(spark):
        runs = detections.select("run_id").distinct()
        rows = detections if keep is None else detections.where(keep)
        indexed = numbered(rows.drop("idx"), ["run_id"], [F.col(c) for c in order])
        indexed.withColumn("idx", F.col("idx").cast("int")).write.partitionBy("run_id").parquet(f"{path}/data/version={version}")
        stamp = F.unix_micros(F.current_timestamp())
        manifest = runs.select("run_id", stamp.alias("written_us"))
        manifest.coalesce(1).write.parquet(f"{path}/manifest/version={version}")
    return version


def _newest(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.groupBy("run_id").agg(F.max(F.struct("written_us", "version")).alias("m")).select("run_id", "m.version")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each run. Folders of older versions and of other runs are left out before they are read."""
    newest = _newest(spark, path)
    rows = spark.read.parquet(f"{path}/data").join(newest, ["version", "run_id"], "left_semi").drop("version")
    return rows.withColumn("run_id", F.col("run_id").cast(newest.schema["run_id"].dataType))


def obsolete_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version) of the writes of which no run is the newest any more: their folders may go."""
    return spark.read.parquet(f"{path}/manifest").select("version").distinct().join(_newest(spark, path), "version", "left_anti")
