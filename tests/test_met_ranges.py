"""Ranges of very unlike lengths: every pair that touches once, and few rows for long ones."""

import random

from cuelake.operators import intervals


def test_ranges_of_all_lengths_meet_once(spark):
    rng = random.Random(9)
    make = lambda n: [(i % 2, i, at, at + rng.choice([-3, 0, 1, 10, 11, 160, 161, 4000, 50_000])) for i in range(n) for at in [rng.randrange(-5000, 90_000)]]
    a, b = make(150), make(220)
    left = spark.createDataFrame(a, "item_id long, i long, start long, end long")
    right = spark.createDataFrame(b, "item_id long, j long, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.overlap_pairs(left, right, 10).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_long_ranges_make_few_rows(spark):
    # Five billion stretches of the given width each: more than an array of them can hold.
    left = spark.range(40).selectExpr("id % 3 as item_id", "id as i", "id * 100000000000 as start", "id * 100000000000 + 50000000000 as end")
    met = intervals.overlap_pairs(left, left.withColumnsRenamed({"i": "j", "start": "r_start", "end": "r_end"}), 10)
    assert met.where("i = j").count() == met.count() == 40


def test_short_ranges_among_a_long_one(spark):
    left = spark.range(3000).selectExpr("1 as item_id", "id as i", "id * 20 as start", "id * 20 + 5 as end")
    long = spark.createDataFrame([(1, 0, 0, 70_000), (1, 1, 400, 401)], "item_id int, j long, r_start long, r_end long")
    got = intervals.overlap_pairs(left, long, 10)
    assert {r.j: r["count"] for r in got.groupBy("j").count().collect()} == {0: 3000, 1: 1}
