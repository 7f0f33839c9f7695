"""Filters, distinct lists, statistics and graphs over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized


def search_filter(groups: Sequence[str] | None = None, speakers: Sequence[str] | None = None, low: float | None = None, high: float | None = None, *, group_col: str = "video_id", speaker_col: str = "speakers", start: str = "start", end: str = "end") -> Column:
    """The conditions of a search, all that are given: groups, any of the speakers, and a time range with both ends included. Missing times count as 0."""
    cond = F.lit(True)
    if groups:
        cond &= F.col(group_col).isin(list(groups))
    if speakers:
        cond &= F.coalesce(F.arrays_overlap(F.col(speaker_col), F.array(*[F.lit(s) for s in speakers])), F.lit(False))
    if low is not None:
        cond &= F.coalesce(F.col(end), F.lit(0.0)) >= low
    if high is not None:
        cond &= F.coalesce(F.col(start), F.lit(0.0)) <= high
    return cond


def contains_text(needle: str, *columns: Column) -> Column:
    """Whether the lower-case needle stands in the columns' text, joined by spaces; arrays count as their words."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def ordered_distinct(df: DataFrame, group: str, value: str, order: str, limit: int | None = None) -> DataFrame:
    """group, values: the distinct values in order of first appearance."""
    first = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"])
    return first.groupBy(group).agg((listed if limit is None else F.slice(listed, 1, limit)).alias("values"))


def statistics(value: str) -> list[Column]:
    """Mean, median, sample and population deviation and variance (0 for fewer than two), extremes and mode (the least of several)."""
    v = F.col(value)
    return [
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.stddev_pop(v).alias("pstdev"), F.min(v).alias("least"), F.max(v).alias("most"), F.expr(f"mode() WITHIN GROUP (ORDER BY {value})").alias("mode"),
    ]


def bit_hash(vector: str, bits: int) -> Column:
    """The signs of the first ``bits`` components as bits of a number."""
    signs = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, b: a + b)


def hamming_search(queries: DataFrame, rows: DataFrame, radius: int, bits: int = 64, query: str = "query", row_id: str = "id", word: str = "hash") -> DataFrame:
    """query, id, distance of all rows within ``radius`` bits of a query's word.

    The word is cut into radius + 1 bands; two words so near agree on one of them at least, so equal bands are joined and pairs verified.
    """
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def banded(df: DataFrame, names: list[Column]) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(i).alias("i"), F.col(word).bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])
        return df.where(F.col(word).isNotNull()).select(*names, F.explode(bands).alias("b"))

    a = banded(queries, [F.col(query).alias("query"), F.col(word).alias("x")])
    b = banded(rows, [F.col(row_id).alias("id"), F.col(word).alias("y")])
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    pairs = a.join(b, "b").where(distance <= radius).select("query", "id", distance.alias("distance"), F.col("b.i").alias("i"), "x", "y")
    # a pair counts in the first band that it shares
    first = F.coalesce(*[F.when((F.col("x").bitwiseAND(F.lit(m))) == F.col("y").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)])
    return pairs.where(F.col("i") == first).select("query", "id", "distance")


def graph_depths(edges: DataFrame, rounds: int = 1_000) -> DataFrame:
    """node, depth: the longest way to each node of an acyclic graph (columns node, needs; needs null or unknown for sources), which orders it topologically.

    Level by level: a node is settled in the round after the last of what it needs, so each edge is looked at once a level and no path is listed. A node that needs itself, directly or not,
    would never settle: that is an error, as is a graph of more levels than ``rounds``. Repeated edges do no harm.
    """
    e = materialized(edges.where(F.col("node").isNotNull()).distinct())
    every = e.select("node").distinct()
    real = materialized(e.where(F.col("needs").isNotNull()).join(every.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node", "needs"))
    waiting, done = real, None
    settled = materialized(every.join(real.select("node").distinct(), "node", "left_anti").withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        done = settled if done is None else done.unionByName(settled)
        if waiting.isEmpty():
            break
        # edges whose needs are settled go; nodes that have none left are the next level
        left = materialized(waiting.join(settled.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"))
        freed = waiting.select("node").distinct().join(left.select("node").distinct(), "node", "left_anti")
        settled = materialized(freed.withColumn("depth", F.lit(depth)))
        if settled.isEmpty():
            raise ValueError("the graph has a cycle")
        waiting = left
    else:
        raise ValueError(f"the graph has more than {rounds} levels")
    return done


def graph_ancestors(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, ancestor: the transitive closure of needs (columns node, needs). Ways double in length each round, so rounds are the logarithm of the longest; cycles end, too.

    A round has all pairs at most 2**k - 1 edges apart and those that ways of exactly 2**k edges join; only these go on from it, so a longer way is put together once, not at each of its nodes.
    """
    far = materialized(edges.where(F.col("node").isNotNull() & F.col("needs").isNotNull()).select("node", F.col("needs").alias("ancestor")).distinct())
    now, n = far, far.count()
    for k in range(rounds):
        onward = far.select("node", F.col("ancestor").alias("mid"))
        if k:  # in the first round ways of one edge are all there is
            longer = onward.join(now.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
            now = materialized(now.unionByName(far).unionByName(longer).distinct())
            if (m := now.count()) == n:
                break
            n = m
        far = materialized(onward.join(far.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor").distinct())
        if far.isEmpty():
            break
    return now
