"""Exact medians against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cuelake.operators import medians


@pytest.mark.parametrize("bins", [16, 1024])
def test_medians(spark, monkeypatch, bins):
    monkeypatch.setattr(medians, "BINS", bins)
    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 1e-9) for _ in range(301)], "b": [rng.choice([1.0, 1.0, 2.0, 1e300, -1e300]) for _ in range(200)], "c": [4.0], None: [1.0, 2.0], "d": [1.7e308, -1.7e308], "e": [5.0] * 90 + [None] * 400}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in medians.exact_medians(df, ["k"], "v").collect()}
    assert got == {k: statistics.median([v for v in vs if v is not None]) for k, vs in values.items()}
    assert medians.exact_medians(df.where("k in ('a', 'b')"), [], "v", "m").first().m == statistics.median(values["a"] + values["b"])
    assert medians.exact_medians(df.where("false"), [], "v").first().median is None and medians.exact_medians(df.where("false"), ["k"], "v").count() == 0
    whole = spark.createDataFrame([(2**60 + k % 5,) for k in range(100)], "v long")
    assert medians.exact_medians(whole, [], "v").first().median == float(2**60 + 2)
    assert medians.exact_medians(spark.range(1001).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")), ["k"], "v").count() == 3
