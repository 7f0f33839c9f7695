"""Approximate nearest neighbours: an index of cells around learned centroids, of which a query searches the few nearest ones.

The centroids and the number of cells to search are fitted on a bounded sample; the index holds every
vector. Crowded cells are dealt out as pairs of blocks, so no task gets an unbounded cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BLOCK, best_of, ranked

#: Vectors that the centroids are fitted on, at most: those of the least hashes, held by the driver. Raise it for more cells.
SAMPLE = 16_384
#: Vectors of the sample that there are for each centroid, at least.
PER_CELL = 16
ROUNDS = 10
#: Vectors of the sample that are searched to find how many cells a query needs, and the share of their neighbours that must be found.
TRIALS = 512
RECALL = 0.97


@dataclass(frozen=True)
class Cells:
    """Unit centroids, and how many of the nearest ones a query searches."""

    centroids: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centroids(x: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from the first n rows; a centroid that loses all its rows stays where it is."""
    c = x[:n].copy()
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        held = np.bincount(home, minlength=n) > 0
        c[held] = _unit(sums[held])
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest nearest cells that hold the asked share of the k nearest rows of the first rows, themselves left out."""
    unit = _unit(x)
    home, trial = (unit @ c.T).argmax(axis=1), np.arange(min(TRIALS, len(x)))
    near = x[trial] @ x.T
    near[trial, trial] = -np.inf
    near = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(unit[trial] @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def fit(vectors: DataFrame, k: int = 10, row_id: str = "id", vector: str = "vec", sample: int = SAMPLE, recall: float = RECALL) -> Cells:
    """Cells for ``vectors``: about the square root of their number, but a sixteenth of ``sample`` at most.

    The sample's neighbours lie farther apart than those among all rows, so the number of cells to search
    errs upwards. Null vectors are skipped; without any vector there are no cells.
    """
    known = vectors.where(F.col(vector).isNotNull()).select(row_id, vector)
    rows = known.orderBy(F.xxhash64(F.lit("cells"), F.col(row_id)), row_id).limit(sample).select(vector).collect()
    if not rows:
        return Cells(np.zeros((0, 0), np.float32), 1)
    x = np.array([r[0] for r in rows], np.float32)
    n = max(1, min(int(np.ceil(np.sqrt(known.count()))), len(x) // PER_CELL))
    c = _centroids(_unit(x), n)
    return Cells(c, _probes(x, c, k, recall))


def _dealt(df: DataFrame, cells: Cells, row_id: str, vector: str, n: int, to: str) -> DataFrame:
    """Each row once for each of its n nearest cells, as columns to, x, cell."""
    centroids, m = cells.centroids, min(n, len(cells.centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and m:
                near = np.argsort(-(_unit(np.stack(b["x"].to_numpy()).astype(np.float32)) @ centroids.T), axis=1, kind="stable")[:, :m]
                yield b.assign(cells=list(near.astype(np.int32)))

    rows = df.where(F.col(vector).isNotNull()).select(F.col(row_id).alias(to), F.col(vector).alias("x"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInPandas(run, f"{to} {kinds[0]}, x {kinds[1]}, cells array<int>").select(to, "x", F.explode("cells").alias("cell"))


def index(vectors: DataFrame, cells: Cells, row_id: str = "id", vector: str = "vec") -> DataFrame:
    """i, x, cell: every vector with its cell. It may be written, partitioned by cell, and read for later searches; rows that are added need no new fit."""
    return _dealt(vectors, cells, row_id, vector, 1, "i")


def search(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int, query_id: str = "query", vector: str = "vec", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: as ``vectors.knn``, but among the rows of each query's nearest cells; scores are exact.

    What is broadcast are row counts of cells. Fewer than k rows come back where the cells searched hold fewer.
    """
    q = _dealt(queries, cells, query_id, vector, cells.probes, "q")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)))

    of_q, of_v = blocks(q, "nq"), blocks(indexed, "nv")

    def part(row_id: str, n: str):
        return F.pmod(F.xxhash64(row_id), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = q.join(of_q, "cell").join(of_v, "cell").select("q", "x", "cell", part("q", "nq").alias("bq"), every("nv").alias("bv"))
    v = indexed.join(of_q, "cell").join(of_v, "cell").select("i", "x", "cell", part("i", "nv").alias("bv"), every("nq").alias("bq"))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((q, "q"), (v, "i"))]
    keys = ("cell", "bq", "bv")
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(best_of(k, skip_self), f"query {kinds[0]}, id {kinds[1]}, score double")
    return ranked(found, "query", "score", "id", k)
