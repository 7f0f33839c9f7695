"""Analysis of ordered signals: robust scores, deltas, islands, cohesion and depth, apportionment.

Everything here is window and array expressions, per group. Groups are recordings: each must fit a task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HALF = 7


def reflected(df: DataFrame, group: str, pos: str, half: int = HALF) -> DataFrame:
    """Rows at their places ``e`` and at every place up to ``half`` beyond the ends that mirrors them.

    ``pos`` counts from 0 without gaps. The signal is mirrored at its first and last row, again and again where it is short.
    """
    counted = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(group)))
    period = F.greatest(2 * (F.col("__n") - 1), F.lit(1))
    turns = F.sequence(F.lit(-half), F.lit(half))
    places = F.array_distinct(F.flatten(F.transform(turns, lambda k: F.array(F.col(pos) + k * period, k * period - F.col(pos)))))
    near = F.filter(places, lambda e: (e >= -half) & (e < F.col("__n") + half))
    return counted.withColumn("e", F.explode(near)).drop("__n")


def robust_scores(df: DataFrame, group: str, pos: str, value: str, half: int = HALF) -> DataFrame:
    """Adds median and z: the rolling median of 2 half + 1 values, and the distance from it in robust deviations of at least 1."""
    frame = W.partitionBy(group).orderBy("e").rowsBetween(-half, half)
    wide = reflected(df, group, pos, half).withColumn("__f", F.collect_list(value).over(frame)).where(F.col("e") == F.col(pos))
    middle = half + 1
    med = wide.withColumn("median", F.element_at(F.array_sort("__f"), middle))
    mad = F.element_at(F.array_sort(F.transform("__f", lambda x: F.abs(x - F.col("median")))), middle)
    return med.withColumn("z", (F.col(value) - F.col("median")) / F.greatest(mad * 1.4826, F.lit(1.0))).drop("__f", "e")


def frame_delta(features: Column, before: Column, luma: Column, luma_before: Column) -> Column:
    """Change between neighbouring frames in 0..100: half the L1 distance of their histograms, and their change of brightness."""
    l1 = F.aggregate(F.zip_with(features, before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 100 * (0.5 * l1 / 2 + 0.42 * F.abs(luma - luma_before))


def islands(df: DataFrame, group: str, idx: str, bridge: int) -> DataFrame:
    """Stretches of rows whose index steps by at most ``bridge``: group, first, last, n."""
    w = W.partitionBy(group).orderBy(idx)
    step = F.col(idx) - F.lag(idx).over(w)
    marked = df.withColumn("__new", F.when(step.isNull() | (step > bridge), 1).otherwise(0)).withColumn("__k", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(group, "__k").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count(F.lit(1)).alias("n")).drop("__k")


def _sum_vectors(vectors: Column, dim: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cohesion(df: DataFrame, group: str, order: str, vector: str, dim: int, window: int = 3) -> DataFrame:
    """group, gap (from 0), cohesion: cosine of the mean unit vectors of the rows before and after each gap."""
    norm = F.greatest(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(1e-9))
    unit = df.withColumn("__u", F.transform(vector, lambda x: x.cast("double") / norm))
    w = W.partitionBy(group).orderBy(order)
    ahead = unit.withColumn("gap", F.row_number().over(w) - 1)
    ahead = ahead.withColumn("__l", F.collect_list("__u").over(w.rowsBetween(1 - window, 0))).withColumn("__r", F.collect_list("__u").over(w.rowsBetween(1, window)))
    sums = ahead.where(F.size("__r") > 0).withColumn("__l", _sum_vectors(F.col("__l"), dim)).withColumn("__r", _sum_vectors(F.col("__r"), dim))
    cosine = dot(F.col("__l"), F.col("__r")) / (F.greatest(F.sqrt(dot(F.col("__l"), F.col("__l"))), F.lit(1e-9)) * F.greatest(F.sqrt(dot(F.col("__r"), F.col("__r"))), F.lit(1e-9)))
    return sums.select(group, "gap", cosine.alias("cohesion"))


def depth(scores: DataFrame, group: str, pos: str, score: str) -> DataFrame:
    """Adds depth: how far a row lies below the peaks that the curve climbs to, without falling, on both sides."""
    w = W.partitionBy(group).orderBy(pos)
    fall_left = F.when(F.lag(score).over(w) >= F.col(score), 0).otherwise(1)
    fall_right = F.when(F.lead(score).over(w) >= F.col(score), 0).otherwise(1)
    marked = scores.withColumn("__fl", fall_left).withColumn("__fr", fall_right)
    runs = marked.withColumn("__kl", F.sum("__fl").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("__kr", F.sum("__fr").over(W.partitionBy(group).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, 0)))
    left, right = F.max(score).over(W.partitionBy(group, "__kl")), F.max(score).over(W.partitionBy(group, "__kr"))
    return runs.withColumn("depth", left - F.col(score) + right - F.col(score)).drop("__fl", "__fr", "__kl", "__kr")


def depth_boundaries(deep: DataFrame, group: str, pos: str, sensitivity: float = 0.55) -> DataFrame:
    """Adds picked: whether a depth lies above mean + sensitivity deviations and no neighbour is deeper."""
    every, w = W.partitionBy(group), W.partitionBy(group).orderBy(pos)
    limit = F.avg("depth").over(every) + sensitivity * F.stddev_pop("depth").over(every)
    most = F.max("depth").over(w.rowsBetween(-1, 1))
    return deep.withColumn("picked", (F.col("depth") > limit) & (F.col("depth") > 1e-6) & (F.col("depth") >= most) & (F.count(F.lit(1)).over(every) > 1))


def apportion(df: DataFrame, group: str, item: str, demand: Column, budget: Column) -> DataFrame:
    """Adds share: one each, the rest of ``budget`` by largest remainders of demand, ties by item. Budgets below the number of items count as that."""
    every = W.partitionBy(group)
    n = F.count(F.lit(1)).over(every)
    d = df.withColumn("__d", demand).withColumn("__free", F.greatest(n, budget) - n)
    exact = F.col("__free") * F.col("__d") / F.coalesce(F.nullif(F.sum("__d").over(every), F.lit(0.0)), F.lit(1.0))
    d = d.withColumn("__x", exact).withColumn("__whole", F.floor("__x"))
    left = F.col("__free") - F.sum("__whole").over(every)
    place = F.row_number().over(every.orderBy(F.desc(F.col("__x") - F.col("__whole")), item))
    return d.withColumn("share", (F.col("__whole") + F.when(place <= left, 1).otherwise(0) + 1).cast("long")).drop("__d", "__free", "__x", "__whole")
