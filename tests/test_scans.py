"""Numbering, running levels and thinning in blocks against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import scans
from spanloom.operators.online import Ewma


def plain_samples(frames, stride):
    """(id, spike) kept of (t, id, delta) rows."""
    state, due, out = Ewma(), -np.inf, []
    for t, i, d in sorted(frames):
        jump = state.push(d or 0.0)
        if t + 1e-6 >= due or jump:
            out.append((i, jump))
            due = t + stride
    return out


def test_numbers_equal_those_of_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 0, 0, 1, 2]), rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, id long")
    got = {(r.g, r.id): r.idx for r in scans.numbered(df, "g", ["o", "id"]).collect()}
    for g in (None, 0, 1, 2):
        ordered = sorted((o, i) for gg, o, i in rows if gg == g)
        assert [got[g, i] for _, i in ordered] == list(range(len(ordered)))
    assert scans.numbered(df.limit(0), "g", ["o"]).collect() == []


@pytest.mark.parametrize("block,run_up", [(64, 64), (scans.BLOCK, scans.RUN_UP)])
def test_samples_equal_one_loop_over_each_recording(spark, block, run_up):
    rng = random.Random(7)
    frames = {}
    for g in range(6):
        n, at = rng.choice([1, 5, 63, 64, 65, 900]), 0.0
        rows = []
        for i in range(n):
            at += rng.choice([0.0, 0.04, 0.04, 0.04, 3.0])
            rows.append((round(at, 3), g * 10_000 + i, None if rng.random() < 0.02 else rng.random() * 0.02 if rng.random() < 0.97 else rng.random()))
        frames[g] = rows
    df = spark.createDataFrame([(g, *r) for g, rows in frames.items() for r in rows] + [(0, None, 77, 0.5)], "g long, t double, id long, d double")
    if block == 64:  # so short a run-up leaves a trace of what was before: the state is compared with one that starts where it does
        numbered = scans.numbered(df.where("t IS NOT NULL"), "g", ["t", "id"])
        got = {(r.g, r.id): r.spike for r in scans.spikes(numbered, "g", "id", "d", block=block, run_up=run_up).collect()}
        for g, rows in frames.items():
            ordered = sorted(rows)
            for k, (_, i, _) in enumerate(ordered):
                state, start = Ewma(), max(0, k // block * block - run_up)
                state.seen = start
                assert got[g, i] == [state.push(d or 0.0) for _, _, d in ordered[start : k + 1]][-1]
        return
    for target in (5, 100):
        got = scans.adaptive_samples(df, "g", "t", "id", "d", target=target, block=block, run_up=run_up).collect()
        for g, rows in frames.items():
            length = max(rows)[0] - min(rows)[0]
            stride = max(0.25, length / target) if length > 0 else 0.25
            want = plain_samples(rows, stride)
            assert sorted((r.id, r.spike) for r in got if r.g == g) == sorted(want)
            deltas = {i: d or 0.0 for _, i, d in rows}
            assert all(r.signal == max(100 * deltas[r.id], 100 * r.spike) for r in got if r.g == g)


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_thinning_in_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    rows = []
    for g in range(5):
        at = rng.uniform(-5, 5)
        for i in range(rng.choice([1, 2, 40, 150])):
            at += rng.choice([0.0, 0.1, 0.5, 1.0, 4.0, 30.0])
            rows.append((g, round(at, 2), g * 1000 + i, 0.7 if rng.random() < 0.05 * g else 0.0))
    df = scans.numbered(spark.createDataFrame(rows, "g long, t double, id long, s double"), "g", ["t", "id"]).withColumn("w", 1.0 + F.col("g"))
    got = scans.thinned(df, "g", "t", "id", F.col("w"), "s", block=block).collect()
    for g in range(5):
        due, want = -np.inf, []
        for _, t, i, s in sorted(r for r in rows if r[0] == g):
            if t + 1e-6 >= due or s > 0:
                want.append(i)
                due = t + 1.0 + g
        assert sorted(r.id for r in got if r.g == g) == want
    assert scans.thinned(df.limit(0), "g", "t", "id", 1.0).collect() == []


def test_brief_events_survive_every_length(spark):
    """Five events of a second each on recordings of ten minutes to three hours: both edges of each are sampled, and samples stay bounded."""
    rng = random.Random(2)
    rows, edges = [], {}
    for g, minutes in enumerate((10, 30, 120, 180)):
        n = minutes * 60 * 2
        events = sorted(rng.sample(range(100, n - 100), 5))
        edges[g] = {e for s in events for e in (s, s + 2)}
        rows += [(g, i / 2, i, 0.4 if i in edges[g] else 0.004 + 0.002 * rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, t double, id long, d double")
    got = scans.adaptive_samples(df, "g", "t", "id", "d", target=200).collect()
    for g, found in edges.items():
        mine = [r for r in got if r.g == g]
        assert found <= {r.id for r in mine if r.spike > 0} and len(mine) <= 200 + 2 * len(found) + 2
    strides = [r.s for r in spark.createDataFrame([(0.0,), (100.0,), (7200.0,)], "d double").select(scans.estimated_stride(F.col("d")).alias("s")).collect()]
    assert strides == [0.25, 0.25, 4.5]
