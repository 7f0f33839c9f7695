"""What an answer rests on: citations at the sentences that matched, and numbers from frames or, where these have none, from speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers
from .assembly import ranked_sentences
from .conversation import BLANKS

#: Sentences that are cited, characters of a quote.
CITED = 6
QUOTE = 300


def share_before(sentences: Column, place: Column) -> Column:
    """The share of all characters that stand before the sentence at a place (from 1)."""
    size = lambda s: F.aggregate(F.transform(s, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    return size(F.slice(sentences, F.lit(1), place - 1)) / F.greatest(size(sentences), F.lit(1))


def refined_citations(hits: DataFrame, limit: int = CITED) -> DataFrame:
    """query, place, doc, start, end, quote, relevance, kind of what an answer cites.

    ``hits``: query, doc, rank, score, terms, sentences (array), start, end, text. Each of a question's best sentences is cited at its own time, the hit's time shared out by
    characters (kind sentence). A question none of whose hits has a sentence keeps its hits as citations, in order (kind hit).
    """
    ranked = ranked_sentences(hits, "terms", "sentences", limit)
    spoken = ranked.join(hits.select("query", "doc", "sentences", "start", "end"), ["query", "doc"])
    at = F.array_position("sentences", F.col("sentence")).cast("int")
    first, length = share_before(F.col("sentences"), at), F.col("end") - F.col("start")
    after = share_before(F.col("sentences"), at + 1)
    exact = spoken.select("query", "place", "doc", F.round(F.col("start") + first * length, 3).alias("start"), F.round(F.col("start") + after * length, 3).alias("end"), F.substring("sentence", 1, QUOTE).alias("quote"), F.col("score").alias("relevance"), F.lit("sentence").alias("kind"))
    rest = hits.where(F.col("rank") <= limit).join(ranked.select("query").distinct(), "query", "left_anti")
    whole = rest.select("query", F.col("rank").alias("place"), "doc", "start", "end", F.substring(F.coalesce("text", F.lit("")), 1, QUOTE).alias("quote"), F.col("score").alias("relevance"), F.lit("hit").alias("kind"))
    return exact.unionByName(whole)


def spoken_passages(hits: DataFrame) -> DataFrame:
    """query, passage: the texts of a question's hits in the recording of its best hit, as one passage in the order of time, so that what runs over two chunks stays together.

    ``hits``: query, rank, video, start, doc, text. Hits without text count for nothing.
    """
    told = hits.where(F.coalesce("text", F.lit("")) != "")
    best = told.groupBy("query").agg(F.min_by("video", "rank").alias("__best"))
    rows = told.join(best, "query").where(F.col("video").eqNullSafe(F.col("__best")))
    parts = F.array_sort(F.collect_list(F.struct("start", "doc", "text")))
    return rows.groupBy("query").agg(F.array_join(F.transform(parts, lambda x: F.btrim(x["text"], F.lit(BLANKS))), " ").alias("passage"))


def collected(points: DataFrame, hits: DataFrame) -> DataFrame:
    """query, place, value, unit, label, source: the numbers that a computation may use.

    ``points``: query, place, label, value, unit read from frames. Where a question has any with a value, they are its evidence (source frame); else the numbers of its spoken passage
    are (source speech).
    """
    seen = points.where(F.col("value").isNotNull()).select("query", "place", F.col("value").cast("double").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("label", F.lit("")).alias("label"), F.lit("frame").alias("source"))
    blind = spoken_passages(hits).join(seen.select("query").distinct(), "query", "left_anti")
    said = numbers.extract_numbers(blind, "query", "passage").withColumn("source", F.lit("speech"))
    return seen.unionByName(said.select("query", "place", "value", "unit", "label", "source"))
