"""How the driver's tables play the roles of the data model; the same derivations stand in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table


def register(queries: dict, oracles: dict):
    """A decorator that enters a query under its own name, with the SQL that it must equal if there is any."""

    def with_sql(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return with_sql


#: Seconds since 1970 of a timestamp without zone.
EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D"
SQL_EPOCH = "epoch_us(ts) / 1000000.0::DOUBLE"
CHUNK_SECONDS = 20


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: video_id, idx, doc_id, start, end, text."""
    docs = table(spark, sf_dir, "documents")
    idx = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    d = docs.select(F.col("source").alias("video_id"), "doc_id", idx.alias("idx"), "text")
    return d.withColumn("start", (F.col("idx") * CHUNK_SECONDS).cast("double")).withColumn("end", F.col("start") + CHUNK_SECONDS)


SQL_CHUNKS = f"""chunks AS (SELECT *, idx * {CHUNK_SECONDS}::DOUBLE AS "start", (idx + 1) * {CHUNK_SECONDS}::DOUBLE AS "end" FROM (
  SELECT source AS video_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, text FROM documents))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spans of value seconds: id, user_id, kind, start, end, value, ts."""
    e = table(spark, sf_dir, "events").withColumn("start", F.expr(EPOCH))
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), "start", (F.col("start") + F.col("value")).alias("end"), "value", "ts")


SQL_SPANS = f"""spans AS (SELECT event_id AS id, user_id, event_type AS kind, {SQL_EPOCH} AS "start", {SQL_EPOCH} + value AS "end", value, ts FROM events)"""
