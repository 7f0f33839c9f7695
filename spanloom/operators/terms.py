"""Keywords, topics and extractive summaries from term statistics per group of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens, suppressed
from ..sources.tables import materialized, spread
from .bm25 import repeated
from .vocabulary import counted_and_best

PHRASE_BOOST = 1.4
#: Group sizes are broadcast for up to this many groups.
BROADCAST_GROUPS = 100_000
#: Frequencies of terms are broadcast for up to this many.
BROADCAST_TERMS = 500_000
#: Terms of a group that are looked at first for its few best that do not contain each other.
FIRST_TERMS = 2_000


def bounded(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def counted(terms: Column) -> Column:
    """The distinct members of an array, in order, each with its number: ``array<struct<term, tf>>``. Counted within the row, so without a shuffle."""
    ordered = F.transform(F.array(F.array_sort(terms)), lambda ts: F.struct(ts.alias("ts"), F.filter(F.sequence(F.lit(0), F.size(ts)), lambda i: (i == 0) | (i == F.size(ts)) | (F.get(ts, i) != F.get(ts, i - 1))).alias("at")))
    runs = lambda b: F.transform(F.slice(b["at"], 1, F.size(b["at"]) - 1), lambda i, k: F.struct(F.get(b["ts"], i).alias("term"), (F.get(b["at"], k + 1) - i).cast("long").alias("tf")))
    return F.flatten(F.transform(ordered, runs))


def term_counts(texts: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """group, item, term, phrase, tf, total: content words and pairs of neighbours; total counts both. An item is one text."""
    t = spread(texts.select(group, item, F.col(text).alias("x")), item, "x").select(group, item, keyword_tokens(F.coalesce("x", F.lit(""))).alias("t")).where(F.size("t") > 0)
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))
    both = F.concat("t", F.when(F.size("t") > 1, pairs).otherwise(F.array().cast("array<string>")))
    each = t.select(group, item, (2 * F.size("t") - 1).alias("total"), F.explode(counted(both)).alias("c"))
    return each.select(group, item, "total", "c.term", "c.tf").withColumn("phrase", F.contains("term", F.lit(" ")))


def keyword_scores(texts: DataFrame, group: str, item: str, text: str, merged: bool = False) -> DataFrame:
    """group, item, term, score. Phrases must recur; terms of every text of a group of several say nothing and go. With ``merged`` texts of an item that are alike in length count as one."""
    counts = term_counts(texts, group, item, text)
    if merged:
        counts = counts.groupBy(group, item, "total", "term", "phrase").agg(F.sum("tf").alias("tf"))
    n = texts.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    small = bounded(n)
    # counted by aggregation, so that no term of a large group gathers its rows in one task; a phrase that recurs nowhere goes here already
    df = counts.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most")).where(~F.contains("term", F.lit(" ")) | (F.col("most") >= 2))
    df = materialized(df.join(F.broadcast(n) if small else n, group).where((F.col("df") < F.col("n")) | (F.col("n") <= 1)).drop("most"))
    side = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    # counts are made from the texts again: far less than to write and read them
    told = counts.where(~F.col("phrase") | (F.col("tf") >= 2)).join(side, [group, "term"])
    weight = (1 + F.log("tf")) / F.log(2.0 + F.col("total"))
    score = weight * F.log((F.col("n") + 1) / (F.col("df") + 0.5)) * F.when(F.col("phrase"), PHRASE_BOOST).otherwise(1.0)
    return told.select(group, item, "term", F.round(score, 6).alias("score"))


def ranked_terms(scores: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank from 1 by score, ties by term."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "term")))


def keywords(scores: DataFrame, group: str, item: str, limit: int = 6) -> DataFrame:
    """group, item, keywords: the best terms without those that contain, or are part of, a better one."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))), lambda x: x["term"])
    return scores.groupBy(group, item).agg(suppressed(ordered, limit).alias("keywords"))


def group_keywords(scores: DataFrame, group: str, limit: int) -> DataFrame:
    """group, keywords: the ``keywords`` of all of a group's terms. Its first FIRST_TERMS are gone through; only where they do not give enough of them, all are."""
    scores = materialized(scores.withColumn("__item", F.lit(0)))
    found = materialized(keywords(ranked_terms(scores, [group]).where(F.col("rank") <= FIRST_TERMS), group, "__item", limit))
    large = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FIRST_TERMS)
    short = found.where(F.size("keywords") < limit).join(large, group).select(group)
    if not short.isEmpty():
        rest = keywords(scores.join(short, group, "left_semi"), group, "__item", limit)
        found = found.join(short, group, "left_anti").unionByName(rest)
    return found.drop("__item")


def topic_scores(texts: DataFrame, group: str, item: str, text: str, found: int = 6) -> DataFrame:
    """group, term, score over words of four characters or more; those that are among the first ``found`` keywords of a text weigh more.

    Words that occur once count only in groups where none recurs. Words are counted, and the keywords of a text found, within blocks of texts; only where ids recur or are null, or where there are very many
    groups, all counts are shuffled.
    """
    n = texts.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    if not bounded(n) or repeated(texts, item):
        t = spread(texts.select(group, item, F.col(text).alias("x")), item, "x").select(group, item, F.explode(keyword_tokens(F.coalesce("x", F.lit("")), 4)).alias("term"))
        per = t.groupBy(group, item, "term").agg(F.count(F.lit(1)).alias("c")).groupBy(group, "term").agg(F.sum("c").alias("tf"), F.count(item).alias("df"))
        best = ranked_terms(keyword_scores(texts, group, item, text, merged=True), [item]).where((F.col("rank") <= found) & ~F.contains("term", F.lit(" ")))
    else:
        words, best = counted_and_best(texts, group, item, text, {r[group]: r["n"] for r in n.collect()}, PHRASE_BOOST, found)
        per = words.where(F.length("term") >= 4)
    recurs = per.groupBy(group).agg(F.max("tf").alias("most"))
    hits = best.groupBy(group, "term").agg(F.count(F.lit(1)).alias("hits"))
    rows = per.join(n, group).join(recurs, group).where((F.col("tf") >= 2) | (F.col("most") < 2)).join(hits, [group, "term"], "left")
    score = (1 + F.log("tf")) * F.sqrt(F.col("df") / F.col("n")) * (1 + 0.35 * F.least(F.coalesce("hits", F.lit(0)), F.lit(3)))
    return rows.select(group, "term", F.round(score, 6).alias("score"))


def summary_scores(found: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, score: how much of the group's keywords a text covers, damped by its own number."""
    mass = found.groupBy(group, "term").agg(F.count(F.lit(1)).alias("c"))
    return found.join(mass, [group, "term"]).groupBy(group, item).agg(F.round(F.sum("c") / (1 + 0.15 * F.count(F.lit(1))), 6).alias("score"))
