"""Queries over the lexical index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import NUMBER_WORDS, lexical_tokens
from ..operators import bm25
from ..sources import sinks
from ..sources.tables import removed_at_exit, shared_folder, table
from .derived import register

_NUMBERS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in NUMBER_WORDS.items()) + "}"
#: Tokens in SQL: words, each number word followed by its digits.
SQL_TOKENS = f"flatten(list_transform(regexp_extract_all(lower(TEXT), '[a-z0-9][a-z0-9''-]*'), lambda w: CASE WHEN ({_NUMBERS})[w] IS NOT NULL THEN [w, ({_NUMBERS})[w]] ELSE [w] END))"


def sql_tokens(column: str) -> str:
    return SQL_TOKENS.replace("TEXT", column)


def bm25_sql(where: str = "true", tail: str = "", queries: str = "SELECT item_id AS query, text FROM benchmark") -> str:
    return f"""
WITH qs AS ({queries}), d AS (SELECT doc_id AS doc, lang, {sql_tokens('text')} AS t FROM documents),
l AS (SELECT doc, lang, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS n, avg(n) AS a FROM l),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({sql_tokens('text')}) AS term FROM qs) GROUP BY ALL),
p AS (SELECT doc, lang, n, term, count(*) AS tf FROM (SELECT doc, lang, n, unnest(t) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (
  SELECT q.query, p.doc, round(sum(p.tf * {bm25.K1 + 1}::DOUBLE / (p.tf + {bm25.K1}::DOUBLE * (1 - {bm25.B}::DOUBLE + {bm25.B}::DOUBLE * p.n / s.a))
    * ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (1 + {bm25.QUERY_BOOST}::DOUBLE * ln(q.qtf + 1))), 6) AS score
  FROM p JOIN q USING (term) JOIN f USING (term), s WHERE {where} GROUP BY 1, 2
)
{tail}"""


_TOP = "SELECT query, doc, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc))::INT AS rank FROM r) WHERE rank <= {}"

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


@query(bm25_sql(tail=_TOP.format(10)))
def bm25_topk(spark, sf_dir):
    """The ten best documents for every benchmark passage."""
    return bm25.top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(bm25_sql(where="p.lang = 'en'", tail=_TOP.format(10)))
def bm25_filtered(spark, sf_dir):
    """The same among English documents, with the statistics of all."""
    return bm25.top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_filter=F.col("lang") == "en")


@query(bm25_sql(tail=_TOP.format(10)).replace("FROM documents", "FROM documents WHERE coalesce(lang, '') <> 'de'"))
def bm25_kept_index(spark, sf_dir):
    """The ten best documents from an index that is kept in the shared folder: all indexed, German ones deleted, compacted."""
    docs, path = table(spark, sf_dir, "documents"), removed_at_exit(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    bm25.add_documents(docs, path)
    bm25.delete_documents(spark, docs.where("lang = 'de'"), path)
    bm25.compact(spark, path)
    sinks.remove_unnamed(spark, path)
    return bm25.search_index_top(spark, path, table(spark, sf_dir, "benchmark"))


_POSTINGS = f"WITH p AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest({sql_tokens('text')}) AS term FROM documents WHERE WHERE_) GROUP BY ALL)"


@query(_POSTINGS.replace("WHERE_", "true") + f", l AS (SELECT len({sql_tokens('text')}) AS n FROM documents) SELECT (SELECT count(*) FROM l WHERE n > 0) AS docs, count(DISTINCT term) AS vocabulary, count(*) AS postings, round((SELECT avg(n) FROM l WHERE n > 0), 6) AS mean_length FROM p")
def bm25_stats(spark, sf_dir):
    """Corpus statistics of the lexical index."""
    docs = table(spark, sf_dir, "documents")
    by_term = bm25.postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = by_term.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("postings"))
    lengths = bm25.doc_lengths(docs).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("len"), 6).alias("mean_length"))
    return lengths.join(F.broadcast(terms), how="cross")  # one row each


@query(_POSTINGS.replace("WHERE_", "lang <> 'de'") + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY 1")
def postings_after_delete(spark, sf_dir):
    """Document frequencies after German documents are deleted from the index."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("lang = 'de'").select(F.col("doc_id").alias("doc"))
    few = gone.limit(bm25.BROADCAST_IDS + 1).count() <= bm25.BROADCAST_IDS
    left = bm25.postings(docs).join(F.broadcast(gone) if few else gone, "doc", "left_anti")
    return left.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents")
def tokens_number_words(spark, sf_dir):
    """Lexical tokens of every document, number words with their digits."""
    t = lexical_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))
