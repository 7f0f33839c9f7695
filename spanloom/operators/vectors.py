"""Exact nearest neighbours in blocks, and roll-ups of child hits to their parents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of vectors: what one task holds, and the size of its product matrix.
BLOCK = 4096


def block_of(row_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int")


def best_of(k: int, skip_self: bool):
    """Maps a block of queries (q, x) and one of vectors (i, x) to the k rows of largest product per query."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "id": [], "score": []}
        if len(a) and len(b):
            b = b.sort_values("i", kind="stable")
            ids = b["i"].to_numpy()
            scores = np.round(np.stack(a["x"].to_numpy()).astype(np.float64) @ np.stack(b["x"].to_numpy()).astype(np.float64).T, 6)
            for query, row in zip(a["q"].to_numpy(), scores, strict=True):
                if skip_self:
                    row = np.where(ids == query, -np.inf, row)
                m = min(k, len(row))
                near = np.flatnonzero(row >= np.partition(row, len(row) - m)[len(row) - m])
                near = near[np.argsort(-row[near], kind="stable")][:m]
                near = near[np.isfinite(row[near])]
                out["query"] += [query] * len(near)
                out["id"] += ids[near].tolist()
                out["score"] += row[near].tolist()
        return pd.DataFrame(out)

    return best


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query", row_id: str = "id", vector: str = "vec", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: the k rows of largest dot product per query, ties by id; a query never finds its own id.

    Both sides are cut into blocks by a hash, and every pair of blocks is one matrix product that
    keeps k rows per query; a window then takes the best k of those. Products are of doubles,
    rounded to six places. Null vectors are skipped.
    """
    q, v = queries.where(F.col(vector).isNotNull()), vectors.where(F.col(vector).isNotNull())
    nq, nv = (max(1, -(-d.count() // block)) for d in (q, v))
    q = q.select(F.col(query_id).alias("q"), F.col(vector).alias("x"), block_of(query_id, nq).alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("bv"))
    v = v.select(F.col(row_id).alias("i"), F.col(vector).alias("x"), block_of(row_id, nv).alias("bv"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"))

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((q, "q"), (v, "i"))]
    found = q.groupBy("bq", "bv").cogroup(v.groupBy("bq", "bv")).applyInPandas(best_of(k, skip_self), f"query {kinds[0]}, id {kinds[1]}, score double")
    return ranked(found, "query", "score", "id", k)


def ranked(df: DataFrame, group: str, score: str, item: str, k: int | None = None) -> DataFrame:
    """Adds rank from 1 per group by score, ties by item; at most k rows a group."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), item)))
    return out if k is None else out.where(F.col("rank") <= k)


def rollup(hits: DataFrame, query: str, parent: str, child: str, score: str) -> DataFrame:
    """Per query and parent the best child's score and id; ties by child."""
    return hits.groupBy(query, parent).agg(F.max(score).alias("score"), F.min_by(child, F.struct(-F.col(score), F.col(child))).alias("best_child"))
