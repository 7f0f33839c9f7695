"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns they are given, whatever their names; nulls in any column, empty texts, repeated
rows and empty tables pass through as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, classifier, mixing, pii, simhash
from spanloom.llm.common import local_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the subword classifier, trained on the labelled ones among them, scores 0.5 or more."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score_documents(docs, model, keep=docs.columns, out="__quality").where("__quality >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each class of SimHash near-duplicates."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    return pii.redact_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by the Poisson counts of their sources, in a global random order."""
    return mixing.poisson_mix(docs, mixing.source_rates(docs), copy_col="__copy").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with their number and digests."""
    return bpe.encode_and_digest(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("poisson mixing", mixture),
    ("bpe encoding", encoding),
]

#: The stages are learned, iterative or hashed text functions; SQL has no form of them.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = local_folder("pipeline-")
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one kept is written as Parquet to the shared folder and read again by the next.

    Once a stage is written, what its predecessor kept is deleted, so that one copy of the corpus remains: that of the last stage's input,
    which the result reads.
    """
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
