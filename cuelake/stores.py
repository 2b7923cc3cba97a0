"""Durable intermediate tables in the shared folder: a lost executor costs a reread and no recomputation."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/cuelake/{name}-{uuid.uuid4().hex}"


#: Paths and bucketed tables written within each open ``scratch``, innermost last.
_OPEN: list[list] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end, also after a failure, what was materialised inside. ``keep(df)`` hands a table on
    to the caller, or to the scratch around this one."""
    _OPEN.append(mine := [])
    try:
        yield
    finally:
        _OPEN.remove(mine)
        for held in mine:
            if isinstance(held, Stored):
                held.drop()
            else:
                delete_folder(spark, held)


def keep(table):
    """Spares a materialised or bucketed table from the innermost scratch."""
    held = table if isinstance(table, Stored) else table._cuelake_path
    if _OPEN and held in _OPEN[-1]:
        _OPEN[-1].remove(held)
        if len(_OPEN) > 1:
            _OPEN[-2].append(held)
    return table


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: the lineage ends there,
    so a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cuelake_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    path = getattr(df, "_cuelake_path", None)
    if path:
        delete_folder(df.sparkSession, path)
        if _OPEN and path in _OPEN[-1]:
            _OPEN[-1].remove(path)


class Stored:
    """A bucketed table below the shared folder: joins on its keys don't shuffle it."""

    def __init__(self, df: DataFrame, name: str, keys: list[str]):
        self.spark = df.sparkSession
        self.name, self.path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_folder(self.spark, name)
        writer = df.write.format("parquet").option("path", self.path).option("compression", "zstd")
        writer.bucketBy(shuffle_partitions(self.spark), *keys).saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        if _OPEN:
            _OPEN[-1].append(self)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.spark, self.path)
        if _OPEN and self in _OPEN[-1]:
            _OPEN[-1].remove(self)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than there are cores, such as one large row group, dealt to all of them, before much is made of each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
