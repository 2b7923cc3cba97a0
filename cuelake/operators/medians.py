"""Exact medians of groups of any size: the middle is narrowed down by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import keep, materialise, release, scratch

#: Ranges into which what is left of a group is counted in one pass.
BINS = 1024


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the median of the values of each key as a double, half the sum of the two in the middle where they are even in number. Null values don't
    count; keys without a value have no row; keys may be null, and without ``keys`` there is one row, null if nothing has a value.

    A pass counts the values between the known bounds of the middle ones in ranges of equal width, summed up before they are shuffled, and takes the range that holds the place asked for
    with its least and greatest value as the next bounds, until they are one. No task holds a group's values, and each
    pass reads only what lay within the bounds of the one before; a thousand ranges a pass make few passes.
    """
    with scratch(df.sparkSession):
        k = F.struct(*keys) if keys else F.lit(0)
        live = materialise(df.where(F.col(value).isNotNull()).select(k.alias("k"), F.col(value).alias("v")), "values")
        bounds = live.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        # The places of the two in the middle, from 0.
        asked = materialise(bounds.select("k", "lo", "hi", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))).alias("place")).distinct().withColumn("at", F.col("place")), "bounds")
        while True:
            open_ = asked.where("lo < hi")
            if not open_.limit(1).count():
                break
            spans = open_.select("k", "place", "lo", "hi", "at")
            inner = live.join(spans, "k").where("v between lo and hi")
            bin_ = F.least(F.floor(_width(live, "lo", "v") / _width(live, "lo", "hi") * BINS), F.lit(BINS - 1))
            counts = inner.groupBy("k", "place", "at", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            upto = Window.partitionBy("k", "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            found = counts.where("at >= before and at < before + n").select("k", "lo", "hi", "place", (F.col("at") - F.col("before")).alias("at"))
            narrowed = materialise(asked.where("lo = hi").union(found), "bounds")
            left = narrowed.where("lo < hi").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            rest = materialise(live.join(left, "k").where("v between lo and hi").select("k", "v"), "values")
            release(asked)
            release(live)
            asked, live = narrowed, rest
        middle = asked.groupBy("k").agg(((F.min("lo").cast("double") + F.max("lo").cast("double")) / 2).alias(name))
        if not keys:
            return keep(materialise(middle.agg(F.max(name).alias(name)), "medians"))
        return keep(materialise(middle.select(*[F.col(f"k.{c}").alias(c) for c in keys], name), "medians"))


def _width(df: DataFrame, a: str, b: str) -> Column:
    """From a to b as a double. Whole numbers are subtracted as such; of others halves, since their difference may be no number."""
    if df.schema["v"].dataType.typeName() in ("double", "float"):
        return F.col(b).cast("double") / 2 - F.col(a).cast("double") / 2
    return (F.col(b).cast("decimal(38,6)") - F.col(a).cast("decimal(38,6)")).cast("double")
