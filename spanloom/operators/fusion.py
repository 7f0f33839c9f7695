"""Weighted reciprocal rank fusion, temporal smoothing and ranking metrics over long lists (query, channel, doc, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60.0
FLOOR = 0.25
TEMPERATURE = 0.1
DECAY = 45.0
BONUS = 0.18
#: How much each channel counts before its scores are seen.
PRIORS = {"text": 1.0, "summary": 0.85, "image": 0.8, "lexical": 0.9}


def prior(channel: Column, priors: dict[str, float] = PRIORS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])
    return F.coalesce(table[channel], F.lit(1.0))


def weighted(lists: DataFrame, priors: dict[str, float] = PRIORS) -> DataFrame:
    """Adds weight: prior x (1 - normalised entropy of the channel's scores) x (1 + gap of top and median), at least FLOOR, summing to the number of channels.

    All windows lie within a query, so lists are computed and dealt once.
    """
    channel, every = W.partitionBy("query", "channel"), W.partitionBy("query")
    top, n = F.max("score").over(channel), F.count(F.lit(1)).over(channel)
    s = lists.withColumn("__x", (F.col("score") - top) / TEMPERATURE)
    # entropy of a softmax: ln Z less the mean exponent
    z, ex = F.sum(F.exp("__x")).over(channel), F.sum(F.exp("__x") * F.col("__x")).over(channel)
    entropy = F.when(n <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log(z) - ex / z) / F.log(n))))
    gap = (top - F.percentile("score", F.lit(0.5)).over(channel)) / (F.abs(top) + 1e-12)
    s = s.withColumn("__raw", F.greatest(F.lit(FLOOR), prior(F.col("channel"), priors) * (1 - entropy) * (1 + gap)))
    s = s.withColumn("__one", F.row_number().over(channel.orderBy("rank", "doc")) == 1)
    share = F.col("__raw") * F.count_if("__one").over(every) / F.sum(F.when(F.col("__one"), F.col("__raw"))).over(every)
    return s.withColumn("weight", F.round(share, 6)).select(*lists.columns, "weight", F.col("__one").alias("leads"))


def adaptive_weights(lists: DataFrame, priors: dict[str, float] = PRIORS) -> DataFrame:
    """query, channel, weight."""
    return weighted(lists, priors).where("leads").select("query", "channel", "weight")


def fuse(lists: DataFrame, k: float = RRF_K) -> DataFrame:
    """query, doc, score, best_rank, channels (sorted), contributions: the sum of weight / (k + rank). Lists without a weight count 1."""
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in lists.columns else F.lit(1.0)
    part = lists.withColumn("c", weight / (k + F.col("rank")))
    return part.groupBy("query", "doc").agg(
        F.round(F.sum("c"), 6).alias("score"),
        F.min("rank").alias("best_rank"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round("c", 6).alias("c"))))).alias("contributions"),
    )


def fused_order(fused: DataFrame) -> DataFrame:
    """Adds place from 1: by score, then best rank, then document."""
    return fused.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "best_rank", "doc")))


def diffuse(rows: DataFrame, group: str, row_id: str, mid: str, score: str, decay: float = DECAY, bonus: float = BONUS) -> DataFrame:
    """group, id, score: each row's score plus ``bonus`` times its neighbours', fading with the distance of their middles, up to four ``decay``.

    Middles meet in buckets as wide as that radius; a row looks into its own and both next ones. Rows without a middle go.
    """
    radius = 4 * decay
    base = rows.where(F.col(mid).isNotNull()).select(F.col(group), F.col(row_id).alias("id"), F.col(mid).alias("m"), F.col(score).alias("s")).withColumn("b", F.floor(F.col("m") / radius))
    seen = base.select(F.col(group).alias("g2"), F.col("id").alias("id2"), F.col("m").alias("m2"), F.col("s").alias("s2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b2"))
    gap = F.abs(F.col("m") - F.col("m2"))
    pairs = base.join(seen, (F.col(group) == F.col("g2")) & (F.col("b") == F.col("b2")) & (F.col("id") != F.col("id2")) & (gap <= radius))
    gained = pairs.groupBy(group, "id").agg(F.sum(F.col("s2") * F.exp(-gap / decay)).alias("gain"))
    return base.join(gained, [group, "id"], "left").select(group, "id", (F.col("s") + bonus * F.coalesce("gain", F.lit(0.0))).alias("score"))


def metrics(lists: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, recall, mrr of ranked lists (query, doc, rank) against gains (doc, gain); a positive gain is relevant. Each document counts once."""
    gains = gains.groupBy("doc").agg(F.max("gain").cast("double").alias("gain"))
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("gain") > 0, F.col("gain"))), False), 1, k)
    # the ideal needs only the k largest gains, taken by a top-k before anything is collected
    best = gains.where("gain > 0").orderBy(F.desc("gain")).limit(k)
    ideal = best.agg(top.alias("g")).select(F.aggregate(F.sequence(F.lit(1), F.size("g")), F.lit(0.0), lambda s, i: s + F.when(F.size("g") >= i, F.try_element_at("g", i) / F.log2(i + 1.0)).otherwise(0.0)).alias("ideal")).first()["ideal"] or 0.0
    n = gains.where("gain > 0").count()
    hit = lists.join(gains, "doc", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    within = F.col("rank") <= k
    return hit.groupBy("query").agg(
        F.round(F.sum(F.when(within, F.col("gain") / F.log2(F.col("rank") + 1.0))) / F.lit(ideal or 1.0), 6).alias("ndcg"),
        F.round(F.count_if(within & (F.col("gain") > 0)) / F.lit(float(n or 1)), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("gain") > 0, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


def best_of(lists: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """The best score of each document over several result sets of a query."""
    return lists.groupBy(query, doc).agg(F.max(score).alias(score))
