"""Claims and batches: no item is one task or group, and results are those of one step after another."""

import random

from pyspark.sql import functions as F

from cuelake.operators import align, intervals, scoring


def test_claims_equal_one_step_after_another(spark):
    rng = random.Random(4)
    pairs = sorted({(i % 3, rng.randrange(60), rng.randrange(70)) for i in range(500)} | {(7, 1, 1), (7, 2, 2), (7, 3, 2)})
    rows = [(i, a, b, rng.randrange(4)) for i, a, b in pairs]
    want, taken, served = set(), set(), set()
    for i, a, away, b in sorted((i, a, away, b) for i, a, b, away in rows):
        if (i, a) not in served and (i, b) not in taken:
            served.add((i, a))
            taken.add((i, b))
            want.add((i, a, b, away))
    out = scoring.claim_pairs(spark.createDataFrame(rows, "item_id long, l int, r int, away int"), "l", "r", ["away", "r"])
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" not in plan


def test_items_are_not_held_whole(spark):
    segs = spark.range(3000).select((F.col("id") % 2).alias("item_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 3.0).alias("end"))
    out = intervals.batch_segments(segs, 40, 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.item_id, r.start, r.batch) for r in out.collect()) == [(i, float(2 * k + i), k // 4) for i in (0, 1) for k in range(1500)]
    hits = spark.createDataFrame([(1, 7, 0, 9, 5.0, ["a"])], "hit_id long, item_id long, start_ms long, end_ms long, expected_ms double, targets array<string>")
    words = spark.createDataFrame([(7, 0, "a", 0, 9)], "item_id long, word_index int, word string, start_ms long, end_ms long")
    assert "FlatMapGroups" not in align.pick_timing(hits, words)._jdf.queryExecution().optimizedPlan().toString()
