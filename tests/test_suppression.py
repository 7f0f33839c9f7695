"""Greedy suppression in rounds against the loop over each group."""

import random

import pytest

from spanloom.operators import sequential, suppression


@pytest.mark.parametrize("block", [5, suppression.BLOCK])
def test_equals_the_loop_over_each_group(spark, block):
    rng = random.Random(block)
    rows, n = [], 0
    for g in (None, 1, 2, 3):
        word = rng.getrandbits(64)
        for _ in range(0 if g is None else rng.choice([1, 30, 60])):
            step = rng.random()
            if step < 0.3:
                word ^= 1 << rng.randint(0, 63)  # a chain of small changes
            elif step < 0.4:
                word = rng.getrandbits(64)
            n += 1
            rows.append((g, rng.randint(0, 20), n, None if rng.random() < 0.03 else word - (1 << 64) if word >> 63 else word, rng.randint(0, 3) / 2))
    df = spark.createDataFrame(rows, "g long, t long, id long, w long, q double")
    for quality in (None, "q"):
        got = sorted((r.g, r.id) for r in suppression.greedy_kept(df, "g", "t", "id", "w", 3, quality, block=block).collect())
        want = sorted((r.g, r.id) for r in sequential.greedy_distinct(df, "g", "t", "id", "w", 3, quality).collect())
        assert got == want


def test_copies_meet_once_and_empty_tables(spark):
    df = spark.range(5000).selectExpr("1 AS g", "id AS t", "id", "id % 2 AS w", "1.0 AS q")
    assert [(r.g, r.id) for r in suppression.greedy_kept(df, "g", "t", "id", "w", 2).collect()] == [(1, 0)]
    assert suppression.greedy_kept(df.limit(0), "g", "t", "id", "w", 2).collect() == []
