"""Grouped k-means and spectral clustering against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import clustering as C


def voices(rng, n, k, dims=16, noise=0.15):
    centres = rng.normal(size=(k, dims))
    who = np.concatenate([np.arange(k), rng.integers(0, k, n - k)])
    rng.shuffle(who)
    return who, centres[who] + noise * rng.normal(size=(n, dims)) + 3.0  # a common part, as of one room


def dense(x, speakers=8, most=C.NEIGHBOURS):
    """Affinities and the Laplacian's eigenvalues as one matrix, with the same ties."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    n = len(x)
    if n > 2:
        x = x - x.mean(0)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    keep = n
    if n > 3:
        keep = min(max(2, min(n - 1, int(np.rint(n / max(2, min(speakers, n - 1)))) + 1)), most)
    cos = np.round(x @ x.T, 9)
    np.fill_diagonal(cos, 1.0)
    s = np.zeros((n, n))
    for i in range(n):
        order = sorted(range(n), key=lambda j: (j != i, -cos[i, j]))[:keep]
        s[i, order] = (1 + cos[i, order]) / 2
    a = (s + s.T) / 2
    a2 = a @ a
    d = 1 / np.sqrt(a2.sum(1))
    return a, np.linalg.eigvalsh(np.eye(n) - d[:, None] * a2 * d[None, :])


def groups_of(counts):
    rng = np.random.default_rng(5)
    return {g: voices(rng, n, k) for g, (n, k) in enumerate(counts)}


def frame(spark, groups):
    rows = [(g, 1000 * g + i, v.tolist()) for g, (_, x) in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec long, seg long, vec array<double>")


@pytest.fixture(scope="module")
def recordings():
    return groups_of([(60, 3), (40, 2), (150, 5), (3, 2), (1, 1), (2, 2), (12, 3)])


def test_graph_and_spectrum_equal_dense_ones(spark, recordings):
    df = frame(spark, recordings)
    graph = C.neighbour_graph(C.centred(df, "rec", "vec").withColumnRenamed("rec", "r"), "r", "seg", "vec", block=32)
    got = {}
    for e in graph.collect():
        got.setdefault(e.g, {})[e.i - 1000 * e.g, e.j - 1000 * e.g] = e.w
    _, found = C.spectrum(graph)
    values = {r.g: r for r in found.collect()}
    assert set(values) == set(recordings)
    for g, (_, x) in recordings.items():
        a, want = dense(x)
        mine = np.zeros_like(a)
        for (i, j), w in got[g].items():
            mine[i, j] = w
        assert np.allclose(mine, a, atol=1e-8)
        m = len(values[g]["values"])
        assert m == min(len(x), 9)
        # the products span small groups; in the largest the smallest eigenvalues are the nearest
        assert np.allclose(values[g]["values"], want[:m], atol=1e-4 if len(x) <= C.WIDTH * C.POWERS else 0.02), (g, want[:m] - values[g]["values"])


def test_speakers_are_told_apart_and_named_in_order(spark, recordings):
    rows = C.speakers(frame(spark, recordings), "rec", "seg", "vec").collect()
    assert len(rows) == sum(len(x) for _, x in recordings.values())
    for g, (who, x) in recordings.items():
        mine = sorted((r for r in rows if r.rec == g), key=lambda r: r.seg)
        assert [r.seg for r in mine] == [1000 * g + i for i in range(len(x))]
        names = [r.speaker for r in mine]
        assert list(dict.fromkeys(names)) == [f"SPEAKER_{i:02d}" for i in range(len(set(names)))] and {r.speakers for r in mine} == {len(set(names))}
        assert all(0 <= r.confidence <= 1 for r in mine)
        if len(x) >= 40:
            assert len(set(zip(names, who.tolist(), strict=True))) == len(set(who.tolist())) == len(set(names))


def test_kmeans_finds_the_best_of_its_seedings(spark):
    rng = np.random.default_rng(9)
    groups = {g: voices(rng, n, k, dims=3, noise=0.3) for g, (n, k) in enumerate([(300, 4), (50, 3), (5, 5), (4, 4), (2, 2)])}
    df = frame(spark, groups).unionByName(frame(spark, groups).limit(0))
    rows = C.kmeans(df, "rec", "seg", "vec", 4, restarts=4, block=64).collect()
    assert len(rows) == sum(len(x) for _, x in groups.values())
    for g, (_, x) in groups.items():
        mine = {r.seg - 1000 * g: r for r in rows if r.rec == g}
        labels = np.array([mine[i].cluster for i in range(len(x))])
        if len(x) <= 4:
            assert sorted(labels) == list(range(len(x)))
            continue
        centres = np.stack([x[labels == c].mean(0) for c in range(4)])
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (d.argmin(1) == labels).all() or np.isclose(d.min(1), d[np.arange(len(x)), labels]).all()
        assert np.isclose(mine[0].inertia, d.min(1).sum(), rtol=1e-6)
        best = min(plain_kmeans(x, 4, s) for s in range(10))
        assert mine[0].inertia <= best * 1.05


def plain_kmeans(x, k, seed):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(50):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_equal_rows_nulls_and_empty_tables(spark):
    same = spark.createDataFrame([(0, i, [1.0, 2.0]) for i in range(200)] + [(1, 5, None), (2, 1, [1.0, 0.0])], "rec long, seg long, vec array<double>")
    graph = C.neighbour_graph(same.where("rec = 0"), "rec", "seg", "vec")
    assert graph.groupBy("i").count().agg(F.max("count")).first()[0] < 120  # no hub among equal rows
    got = C.speakers(same, "rec", "seg", "vec").collect()
    assert len(got) == 201 and {r.speaker for r in got if r.rec == 2} == {"SPEAKER_00"}
    assert C.speakers(same.limit(0), "rec", "seg", "vec").collect() == []
    assert C.kmeans(same, "rec", "seg", "vec", 3, restarts=2).where("rec = 0").count() == 200
    assert C.kmeans(same.limit(0), "rec", "seg", "vec", 3).collect() == []
