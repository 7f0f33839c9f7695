"""Token counts from an exact length histogram.

Documents are counted by encoded length once. Suffix sums over the lengths then answer, for every
context limit, how many documents and tokens lie at or above it, what truncation keeps, and every
quantile, without a second look at the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LEAF_CHARS, worker_encoder
from .common import checkpointed, map_text, table

#: Lengths per block of the two-level suffix sum: no task holds more lengths than this, nor more block totals than blocks.
BLOCK = 256


def token_lengths(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``n_tokens long`` of every whole text; null and empty texts have 0."""

    def make():
        encoder = worker_encoder(path, leaf_chars)
        return lambda texts: [[len(ids) for ids in encoder.encode(texts)]]

    return map_text(df, make, T.StructType([T.StructField("n_tokens", T.LongType())]), text_col, keep)


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per distinct length: n_tokens, n_docs. Null lengths are not counted; an empty table gives no row."""
    return lengths.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each occurring length, taken as a context limit:

    docs_at_least and tokens_at_least count what has that length or more; docs_at_most gives
    quantiles (the q-quantile is the least length whose docs_at_most reaches q times all documents);
    truncated_total is the sum of min(length, limit) over all documents, lost_total the rest.
    Sums are taken within blocks of lengths and over block totals, so no task sees all lengths. The
    histogram is read twice, hence checkpointed: the documents behind it are encoded once.
    """
    cells = checkpointed(hist).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above, every = W.orderBy(F.desc("block")), W.partitionBy()
    blocks = blocks.select(
        "block",
        (F.sum("bd").over(above) - F.col("bd")).alias("docs_above"),
        (F.sum("bt").over(above) - F.col("bt")).alias("tokens_above"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = F.col("docs_above") + F.sum("n_docs").over(inside)
    tokens_at_least = F.col("tokens_above") + F.sum("tokens").over(inside)
    kept = F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least
    return cells.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("all_docs") - at_least + F.col("n_docs")).alias("docs_at_most"),
        kept.alias("truncated_total"),
        (F.col("all_tokens") - kept).alias("lost_total"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For every limit of a list, occurring as a length or not, one row: limit, docs_at_least, tokens_at_least, truncated_total, lost_total.

    Each follows from the suffix sums of the next occurring length. Limits are a parameter (repeated ones count once); without documents all sums are 0.
    """
    wanted = sorted({int(x) for x in limits})
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in wanted], "limit long")
    whole = sums.agg(F.coalesce(F.max(F.col("truncated_total") + F.col("lost_total")), F.lit(0)).alias("all_tokens"))
    # no join: a length answers those limits between its predecessor and itself, and the least length stays for each limit
    under = F.filter(F.array(*[F.lit(x).cast("long") for x in wanted]), lambda x: x <= F.col("n_tokens"))
    nearest = (
        sums.select(F.explode(under).alias("limit"), "n_tokens", F.struct("docs_at_least", "tokens_at_least", "truncated_total").alias("s"))
        .groupBy("limit")
        .agg(F.min("n_tokens").alias("n_tokens"), F.min_by("s", "n_tokens").alias("s"))
    )
    kept = F.coalesce(F.col("s.truncated_total") - (F.col("n_tokens") - F.col("limit")) * F.col("s.docs_at_least"), F.col("all_tokens"))
    # whole is one row
    return (
        asked.join(F.broadcast(nearest), "limit", "left")
        .crossJoin(F.broadcast(whole))
        .select(
            "limit",
            F.coalesce("s.docs_at_least", F.lit(0)).cast("long").alias("docs_at_least"),
            F.coalesce("s.tokens_at_least", F.lit(0)).cast("long").alias("tokens_at_least"),
            kept.alias("truncated_total"),
            (F.col("all_tokens") - kept).alias("lost_total"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that remain if every document is cut to ``limit``; exact for limits that no document has, too."""
    return at_limits(sums, [limit]).first()["truncated_total"]


def quantiles(sums: DataFrame, shares: Sequence[float | str | Decimal]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of the documents do not exceed; null without documents.

    A share is the decimal number that it is written as (0.07 is 7/100), and its rank is found in whole numbers, so no rounding moves it.
    """
    wanted = sorted({(str(x), Fraction(str(x))) for x in shares}, key=lambda x: x[1])
    if any(not 0 <= f <= 1 for _, f in wanted):
        raise ValueError("shares must be from 0 to 1")
    n = sums.agg(F.max("docs_at_most")).first()[0]
    # a share of 0 asks for the least length
    ranks = [(name, max(1, -(-f.numerator * n // f.denominator)) if n else None) for name, f in wanted]
    asked = sums.sparkSession.createDataFrame(ranks, "share string, rank long")
    if not n:
        return asked.select("share", F.lit(None).cast("long").alias("n_tokens"))
    reached = F.filter(F.array(*[F.lit(r).cast("long") for _, r in ranks]), lambda r: r <= F.col("docs_at_most"))
    found = sums.select(F.explode(F.array_distinct(reached)).alias("rank"), "n_tokens").groupBy("rank").agg(F.min("n_tokens").alias("n_tokens"))
    return asked.join(F.broadcast(found), "rank").select("share", "n_tokens")


def quantile(sums: DataFrame, q: float | str | Decimal) -> int | None:
    """One of ``quantiles``; None without documents."""
    return quantiles(sums, [q]).first()["n_tokens"]


def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums over the token lengths of all ``documents``; null and empty texts have length 0, no documents give no rows."""
    return suffix_sums(histogram(token_lengths(table(spark, sf_dir, "documents"))))


QUERIES = {"op3_token_histogram": op3_token_histogram}
ORACLES: dict[str, str] = {}
