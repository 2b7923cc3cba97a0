"""Sets of different sizes around powers of two, where bit fields differ in length."""

import random

import pytest

from cuelake.llm import ngram_jaccard

from . import brute


@pytest.mark.parametrize("num,den", [(9, 10), (4, 10)])
def test_near_at_field_borders(spark, num, den):
    pick = random.Random(11)
    rows = []
    for size in (60, 120, 250):
        base = [f"w{pick.randrange(10**6)}" for _ in range(size)]
        for k in range(24):
            words = list(base)
            for _ in range(pick.randrange(size // 12)):
                words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + [f"x{pick.randrange(10**6)}" for _ in range(pick.randrange(size // 8))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_jaccard.near_documents(df, n=2, similarity=(num, den)).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(brute.near(rows, 2, num, den), key=repr)
