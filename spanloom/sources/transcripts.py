"""A folder of transcripts as a table: one file per recording, filed by recording and format, read by batch or as a stream.

The folder's layout is Spark's own (``video=.../format=...``), so any store that Spark reads will do, a filter on video or format skips files before
they are opened, and files are dealt out to tasks by size. What is read has the same columns whatever the format.

A file for each of very many recordings costs more than what is in it: every one is a folder to make, to list and to open. Packs hold many transcripts
in a file, each whole and in its format, as rows of Parquet; they are read by batch and stream alike, and give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .subtitles import cues_of, parse_json, timed_words

FORMATS = ("srt", "vtt", "json")
SCHEMA = "value string, video string, format string"


def write_transcripts(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``video, format, body`` as one file each. Of repeated recordings in one format all files stay; rows without a body or with another format are left out."""
    kept = documents.where(F.col("body").isNotNull() & F.col("format").isin(*FORMATS))
    kept.select(F.col("body").alias("value"), F.col("video").cast("string").alias("video"), "format").write.mode(mode).partitionBy("video", "format").text(path)


def write_packs(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``video, format, body`` as packs, filed by format. The same rows are kept as by ``write_transcripts``; files follow the tasks that write, not the recordings."""
    kept = documents.where(F.col("body").isNotNull() & F.col("format").isin(*FORMATS))
    kept.select(F.col("body").alias("value"), F.col("video").cast("string").alias("video"), "format").write.mode(mode).partitionBy("format").parquet(path)


def parsed(files: DataFrame) -> DataFrame:
    """video, format, idx, start, end, speaker, text, words of ``value, video, format``: cues of SRT and WebVTT, segments of JSON with their words.

    Words of cues, and of segments without any, have times in proportion to their lengths. A file that cannot be read as its format has no rows. Narrow, so that it works on streams.
    """
    cues = files.where(F.col("format").isin("srt", "vtt")).select("video", "format", F.posexplode(cues_of(F.col("value"))).alias("idx", "c")).select("video", "format", "idx", "c.*")
    cues = cues.withColumn("words", timed_words(F.col("text"), F.col("start"), F.col("end")))
    keyed = files.where("format = 'json'").select(F.struct("video", "format").alias("path"), F.col("value").alias("content"))
    segments = parse_json(keyed).select("path.video", "path.format", "idx", "start", "end", "speaker", "text", "words")
    return cues.unionByName(segments)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.schema(SCHEMA).text(path, wholetext=True))


def stream_transcripts(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The same rows as files arrive, at most ``per_trigger`` files at once."""
    return parsed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_transcripts`` from packs."""
    return parsed(spark.read.schema(SCHEMA).parquet(path))


def stream_packs(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The same rows as packs arrive, at most ``per_trigger`` packs at once."""
    return parsed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path))


def segments_json(segments: DataFrame, group: str, order: str) -> DataFrame:
    """group, body: each recording's segments (start, end, speaker, text) as a JSON list in order."""
    item = F.struct("start", "end", "speaker", "text")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda v: v["x"])
    return segments.groupBy(group).agg(F.to_json(rows).alias("body"))
