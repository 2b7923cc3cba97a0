"""Chains: rows in order of which each kept one says where the next kept one is.

Batches that close when they are full, events that silence those after them, hits that must not overlap: whether a
row is kept depends on the one kept before it. Here every row first finds by a search which row would follow if it
were kept; the rows that the first one of a group leads to are then found by pointer doubling, in as many rounds as
the logarithm of the longest chain. No step needs a group's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import materialise, release, shuffle_partitions


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with the place of each row (from 0) among those of its keys, in ``order``; ties are told apart in some way.

    Rows are parted by range of keys and order, so a key that holds a third of all rows is numbered by many tasks; what is summed
    over partitions is one row for each partition and key.
    """
    tie = F.monotonically_increasing_id()
    rows = df.withColumn("_tie", tie)
    # The tie is part of the range, so that equal rows can be parted too.
    ranged = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order, "_tie").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order, "_tie")) - 1
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.withColumn("_nth", nth).join(base, same).select(*df.columns, (F.col("_base") + F.col("_nth")).alias(name))


def reached(rows: DataFrame, keys: list[str], idx: str = "idx", following: str = "next") -> DataFrame:
    """(keys, idx) of the rows that the row 0 of each key leads to, itself included, where ``following`` is the place of the
    row after a kept one, null after the last. Keys have no nulls. Each round doubles the length of the chains that are known."""
    jumps = materialise(rows.where(F.col(following).isNotNull()).select(*keys, F.col(idx).alias("idx"), F.col(following).alias("to")), "jumps")
    kept = materialise(rows.where(F.col(idx) == 0).select(*keys, F.col(idx).alias("idx")), "kept")
    while jumps.limit(1).count():
        more = kept.join(jumps, [*keys, "idx"]).select(*keys, F.col("to").alias("idx"))
        grown = materialise(kept.union(more), "kept")
        # Those behind a kept row that has no such jump are none.
        beyond = jumps.select(*keys, F.col("idx").alias("to"), F.col("to").alias("further"))
        doubled = materialise(jumps.join(beyond, [*keys, "to"]).select(*keys, "idx", F.col("further").alias("to")), "jumps")
        release(kept)
        release(jumps)
        kept, jumps = grown, doubled
    return kept.withColumnRenamed("idx", idx)


def first_from(rows: DataFrame, keys: list[str], at: Column, asked: Column, width: float, idx: str = "idx") -> DataFrame:
    """``rows`` with ``next``: the least place among rows of the keys whose ``at`` is not below this row's ``asked``; null if there is none. Places follow ``at``.

    Rows meet in stretches of ``width``; across stretches goes one row for each of them.
    """
    stretch = lambda c: F.floor(c / width)
    points = rows.select(*keys, at.alias("_at"), F.col(idx).alias("_to"), F.lit(None).cast("long").alias("_of"))
    asks = rows.select(*keys, asked.alias("_at"), F.lit(None).cast("long").alias("_to"), F.col(idx).alias("_of"))
    both = points.union(asks).withColumn("_b", stretch(F.col("_at")))
    told = points.withColumn("_b", stretch(F.col("_at"))).groupBy(*keys, "_b").agg(F.min("_to").alias("_to"))
    told = told.unionByName(asks.withColumn("_b", stretch(F.col("_at"))).select(*keys, "_b", F.lit(None).cast("long").alias("_to")).distinct())
    told = told.groupBy(*keys, "_b").agg(F.min("_to").alias("_to"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(*keys, "_b", F.min("_to").over(later).alias("_later"))
    here = Window.partitionBy(*keys, "_b").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.min("_to").over(here)).where("_of is not null").join(told, [*keys, "_b"])
    found = found.select(*keys, F.col("_of").alias(idx), F.coalesce("_here", "_later").alias("next"))
    return rows.join(found, [*keys, idx])
