"""Greedy suppression of near-duplicates within groups of any size: what is kept in order of time, without comparing all with all that is kept.

Distinct words are the nodes of a graph whose links are pairs within the radius; equal bands bring these together. In order of time a node is kept unless an earlier
kept one links to it. Time is cut into blocks of nodes: a round settles one block of every group at once, and what it keeps drops its
neighbours in later blocks. A chain of slowly changing frames therefore takes as many rounds as a group has blocks, not as it has frames.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized
from .scans import numbered

#: Nodes of a group that a round settles.
BLOCK = 4096


def links(nodes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """g, a, b of nodes (g, k, word) within ``radius`` bits of each other, a before b: words so near agree on one of radius + 1 bands."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("word").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)]))
    left = nodes.select(F.col("g"), F.col("k").alias("a"), F.col("word").alias("x"), band.alias("v"))
    right = nodes.select(F.col("g").alias("h"), F.col("k").alias("b"), F.col("word").alias("y"), F.col("forced"), band.alias("w"))
    met = left.join(right, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & ~F.col("forced"))
    near = met.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    # a pair counts in the first band that it shares
    first = F.coalesce(*[F.when(F.col("x").bitwiseAND(F.lit(m)) == F.col("y").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)])
    return near.where(F.col("v.i") == first).select("g", "a", "b")


def greedy_kept(df: DataFrame, group: str, time: str, row_id: str, bits: str, radius: int, quality: str | None = None, width: int = 64, block: int = BLOCK) -> DataFrame:
    """group, id of the rows kept in time order (ties by id): one within ``radius`` bits of a kept one goes, unless it is the group's first of best ``quality``.

    Rows with null bits go. Of equal words only the first, and the best row, can be kept: what drops the first drops the others. Ids are unique within a group; null qualities are never best
    beside others.
    """
    rows = df.where(F.col(bits).isNotNull()).select(F.col(group).alias("g"), F.struct(F.col(time).alias("t"), F.col(row_id).alias("id")).alias("o"), F.col(bits).alias("word"), (F.col(quality).cast("double") if quality else F.lit(None).cast("double")).alias("q"))
    firsts = rows.groupBy("g", "word").agg(F.min("o").alias("o")).withColumn("forced", F.lit(False))
    both = firsts
    if quality:
        top = rows.groupBy("g").agg(F.max("q").alias("m"))
        tops = top.select(F.col("g").alias("h"), "m")
        equal = rows.join(tops, F.col("g").eqNullSafe(F.col("h")) & F.col("q").eqNullSafe(F.col("m")))
        best = equal.groupBy("g").agg(F.min(F.struct("o", "word")).alias("x")).select("g", "x.word", "x.o", F.lit(True).alias("forced"))
        both = firsts.unionByName(best).groupBy("g", "word", "o").agg(F.max("forced").alias("forced"))
    nodes = materialized(numbered(both, "g", ["o"], "k"))
    graph = materialized(links(nodes, radius, width).withColumn("p", F.floor(F.col("a") / block)).withColumn("q", F.floor(F.col("b") / block)))
    last = graph.agg(F.max("q")).first()[0]
    kind = df.schema[group].dataType.simpleString()

    def settle(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for a, b in zip(edges["a"].to_numpy(), edges["b"].to_numpy(), strict=True):
            before.setdefault(int(b), []).append(int(a))
        gone: set[int] = set()
        for b in sorted(before):
            if any(a not in gone for a in before[b]):
                gone.add(b)
        return pd.DataFrame({"g": [key[0]] * len(gone), "k": sorted(gone)})

    dropped = None
    for r in range((last if last is not None else -1) + 1):
        alive = graph
        if dropped is not None:
            out = dropped.select(F.col("g").alias("h"), F.col("k").alias("d"))
            alive = graph.join(out, F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("d")), "left_anti").join(out, F.col("g").eqNullSafe(F.col("h")) & (F.col("a") == F.col("d")), "left_anti")
        here = alive.where((F.col("p") == r) & (F.col("q") == r)).groupBy("g").applyInPandas(settle, f"g {kind}, k long")
        here = materialized(here)
        lost = here.select(F.col("g").alias("h"), F.col("k").alias("d"))
        later = alive.where((F.col("p") == r) & (F.col("q") > r)).join(lost, F.col("g").eqNullSafe(F.col("h")) & (F.col("a") == F.col("d")), "left_anti").select("g", F.col("b").alias("k")).distinct()
        new = here.unionByName(later)
        dropped = materialized(new if dropped is None else dropped.unionByName(new))
    kept = nodes
    if dropped is not None:
        out = dropped.select(F.col("g").alias("h"), F.col("k").alias("d"))
        kept = nodes.join(out, F.col("g").eqNullSafe(F.col("h")) & (F.col("k") == F.col("d")), "left_anti")
    return kept.select(F.col("g").alias(group), F.col("o.id").alias(row_id))
