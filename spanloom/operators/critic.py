"""Retrieval that judges itself: how well hits cover a question, what to ask next where they do not, and whom to cite.

A round retrieves, measures the share of the question's words that the hits hold and how clearly the best hit leads, and asks again, in
the words of what was found, for the questions that are not covered. The number of rounds is fixed, so the loop is a plan of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens
from ..sources.tables import materialized
from . import bm25

#: Words that no question is about, shares that are enough, and how many words a new query takes of what.
STOP = (
    "the a an and or but if then of to in on at for with by is are was were be been being it its this that these those as from into about over under "
    "what when where which who how why does did do said say show shows tell me you your their there here more most some any all can could would should will"
).split()
ENOUGH = 0.6
CLEAR = 0.04
RIVALS = 3
ANCHOR_HITS = 3
ANCHORS = 4
WITH_ANCHORS = 3
ALONE = 5
FROM_FOUND = 6
ASKED_AGAIN = 2
#: Keywords that stand for a document, and hits that a round looks at.
KEYWORDS = 4
HITS = 5
_NONE = "array<string>"


def meaning_words(text: Column) -> Column:
    """The words of a text that carry meaning, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP))


def wanted_terms(text: Column) -> Column:
    return F.array_distinct(meaning_words(text))


def contents(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, terms, keywords (the most frequent content words, ties by word) of the documents that were hit."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("x")).join(hits.select("doc").distinct(), "doc")
    counts = rows.select("doc", F.explode(keyword_tokens(F.coalesce("x", F.lit("")))).alias("w")).groupBy("doc", "w").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "w"))), 1, KEYWORDS)
    keys = counts.groupBy("doc").agg(F.transform(best, lambda x: x["w"]).alias("keywords"))
    return rows.select("doc", wanted_terms(F.col("x")).alias("terms")).join(keys, "doc", "left")


def assessed(questions: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """query, text, coverage, margin, accepted, missing, anchors, seen of every question.

    ``questions``: query, text; ``hits``: query, doc, score, rank; ``found``: doc, terms, keywords. Coverage is the share of the question's words that stand in a hit (1 where it has none),
    margin how far the best hit is above the mean of the next ones, as a share of its score. Without hits both are 0. ``missing`` are words that no hit has, in order; ``anchors``
    keywords of the best hits; ``seen`` the first words of the hits in order.
    """
    q = questions.select("query", "text", wanted_terms(F.col("text")).alias("wanted"))
    each = hits.join(q, "query").join(found, "doc")
    got = F.array_distinct(F.flatten(F.collect_list(F.array_intersect("wanted", "terms"))))
    keys = F.array_sort(F.collect_list(F.when(F.col("rank") <= ANCHOR_HITS, F.struct("rank", F.coalesce("keywords", F.array().cast(_NONE)).alias("k")))))
    words = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice(F.array_sort("terms"), 1, FROM_FOUND))))), 1, FROM_FOUND)
    rest = F.avg(F.when((F.col("rank") > 1) & (F.col("rank") <= 1 + RIVALS), F.col("score")))
    per = each.groupBy("query").agg(
        got.alias("got"), F.slice(F.array_distinct(F.flatten(F.transform(keys, lambda x: x["k"]))), 1, ANCHORS).alias("anchors"), words.alias("seen"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), rest.alias("rest")
    )
    d = q.join(per, "query", "left")
    none = F.array().cast(_NONE)
    share = F.when(F.size("wanted") == 0, 1.0).otherwise(F.size("got") / F.size("wanted"))
    margin = F.when((F.col("top") > 1e-9) & F.col("rest").isNotNull(), (F.col("top") - F.col("rest")) / F.col("top")).otherwise(0.0)
    d = d.withColumn("hit", F.col("got").isNotNull())
    d = d.withColumn("coverage", F.when(F.col("hit"), F.round(share, 6)).otherwise(0.0)).withColumn("margin", F.round(margin, 6))
    d = d.withColumn("accepted", F.col("hit") & (F.col("coverage") >= ENOUGH) & (F.col("margin") >= CLEAR))
    missing = F.array_sort(F.array_except("wanted", F.coalesce("got", none)))
    return d.select("query", "text", "wanted", "hit", "coverage", "margin", "accepted", missing.alias("missing"), F.coalesce("anchors", none).alias("anchors"), F.coalesce("seen", none).alias("seen"))


def asked_next(judged: DataFrame) -> DataFrame:
    """query, asked: what to ask for the questions that were not accepted, at most two texts each, none equal to the question.

    Missing words with keywords of the best hits, and missing words alone; where none is missing the hits' own words. A question without hits
    is broadened: it loses its two longest words, as the most specific are the most likely never said.
    """
    said = lambda *parts: F.array_join(F.concat(*parts), " ")
    m, a = F.col("missing"), F.col("anchors")
    paired = F.when((F.size(m) > 0) & (F.size(a) > 0), said(F.slice(m, 1, WITH_ANCHORS), F.slice(a, 1, WITH_ANCHORS)))
    alone = F.when(F.size(m) > 0, said(F.slice(m, 1, ALONE)))
    own = F.when(F.size(m) == 0, said(F.col("seen")))
    words = meaning_words(F.col("text"))
    by_length = F.array_sort(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w"))))
    broad = F.when(F.size(words) > 2, said(F.transform(F.slice(by_length, F.lit(1), F.greatest(F.lit(2), F.size(words) - 2)), lambda x: x["w"]))).otherwise(F.col("text"))
    texts = F.when(F.col("hit"), F.array(paired, alone, own)).otherwise(F.array(broad))
    fresh = F.filter(F.array_distinct(F.array_compact(texts)), lambda t: (F.trim(t) != "") & (F.lower(t) != F.lower(F.coalesce(F.col("text"), F.lit("")))))
    return judged.where(~F.col("accepted")).select("query", F.slice(fresh, 1, ASKED_AGAIN).alias("asked")).where(F.size("asked") > 0)


def reviewed(docs: DataFrame, questions: DataFrame, rounds: int = 2, hits: int = HITS, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query, round, asked, coverage, margin, accepted) and the final (query, doc, score, rank).

    Round 1 asks every question as it is; each later one asks again for those that are not accepted, and takes of all that was found for a question each document at its best score.
    Null questions count as empty: they have no words and no hits. ``query_id`` is unique.
    """
    asked = questions.select(F.col(query_id).alias("query"), F.col(text_col).alias("text"))
    open_ = asked.withColumn("asked", F.array(F.coalesce("text", F.lit(""))))
    found, log = None, None
    for r in range(1, rounds + 1):
        texts = open_.select("query", F.posexplode("asked").alias("i", "text")).select(F.struct("query", "i").alias("item_id"), "text")
        new = bm25.top(docs, texts, hits, doc_id=doc_id).select("query.query", "doc", "score")
        both = new if found is None else found.select("query", "doc", "score").unionByName(new)
        best = both.groupBy("query", "doc").agg(F.max("score").alias("score"))
        found = materialized(bm25.top_k(best, hits))
        current = found.join(open_.select("query"), "query", "left_semi")
        judged = materialized(assessed(open_.select("query", "text"), current, contents(docs, current, doc_id, text_col)))
        lines = judged.join(open_.select("query", "asked"), "query").select("query", F.lit(r).alias("round"), "asked", "coverage", "margin", "accepted")
        log = lines if log is None else log.unionByName(lines)
        if r < rounds:
            open_ = materialized(asked.join(asked_next(judged), "query"))
    return log, found
