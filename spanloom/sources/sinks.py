"""Keyed tables on Parquet: append of new content, replacement, upsert and deletion by key; exports as lines of text."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """A stable 32-digit id of the parts, each followed by a separator; null parts count as empty."""
    text = F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f"))])
    return F.substring(F.sha2(text, 256), 1, 32)


def with_fingerprint(df: DataFrame, content: str, out: str = "sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def distinct_content(df: DataFrame, content: str, row_id: str) -> DataFrame:
    """The row of least id of every distinct content; null counts as empty."""
    marked = with_fingerprint(df, content, "__sha")
    first = marked.groupBy("__sha").agg(F.min(row_id).alias("__first"))
    return marked.join(first, "__sha").where(F.col(row_id).eqNullSafe(F.col("__first"))).drop("__sha", "__first")


def new_content(df: DataFrame, existing: DataFrame, content: str, row_id: str) -> DataFrame:
    """Distinct contents that the existing table (with sha256) does not have."""
    return with_fingerprint(distinct_content(df, content, row_id), content).join(existing.select("sha256").distinct(), "sha256", "left_anti")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Write rows so that each key value present in ``df`` replaces all it had; other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of greatest version per key over both tables; of equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn", "__new")


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the keys that go, and every child table without their rows."""
    keys = gone.select(key).distinct()
    return delete(parents, keys, [key]), {n: delete(c, keys.withColumnRenamed(key, child_key), [child_key]) for n, c in children.items()}


POINTER = "current.pointer"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and a maker of its paths; works on whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), conf), hadoop, conf


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """What the pointer file of a folder says; None without one."""
    context, hadoop, _ = _files(spark, path)
    at = hadoop.Path(f"{path}/{POINTER}")
    return spark.read.text(at.toString(), wholetext=True).first()[0] if context.util().exists(at) else None


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Set the pointer file by one rename, so that readers see the old or the new one, never half of it."""
    context, hadoop, conf = _files(spark, path)
    new = hadoop.Path(f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = new.getFileSystem(conf).create(new)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(new, hadoop.Path(f"{path}/{POINTER}"), options)


def publish(df: DataFrame, path: str) -> None:
    """Make the rows the table at ``path``: written whole as a new version, then named by the pointer. They may derive from the version before, which stays readable."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    write_pointer(df.sparkSession, path, version)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version of the table that the pointer names."""
    version = read_pointer(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table was published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def remove_unnamed(spark: SparkSession, path: str) -> int:
    """Delete the folders that the pointer's text does not name, once no reader holds them any more; returns how many."""
    _, hadoop, conf = _files(spark, path)
    text, folder = read_pointer(spark, path) or "", hadoop.Path(path)
    system, n = folder.getFileSystem(conf), 0
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name not in text:
            n += system.delete(status.getPath(), True)
    return n


def merge_payloads(old: DataFrame, new: DataFrame, key: str, vector: str = "vector", payload: str = "payload") -> DataFrame:
    """Upsert of vectors: per key the new vector where there is one, and both payload maps, of which the new entries stand. Of repeated new keys the greatest row counts."""
    one = new.groupBy(key).agg(F.max_by(F.struct(vector, F.map_entries(payload).alias("p")), F.struct(vector, F.array_sort(F.map_entries(payload)))).alias("n"))
    both = old.select(key, F.col(vector).alias("ov"), F.col(payload).alias("op")).join(one, key, "full_outer")
    entries = lambda m: F.coalesce(m, F.array().cast("array<struct<key:string,value:string>>"))
    fresh = F.transform(entries(F.col("n.p")), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].cast("string").alias("value")))
    kept = F.filter(entries(F.transform(F.map_entries("op"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), lambda e: ~F.exists(fresh, lambda f: f["key"] == e["key"]))
    return both.select(key, F.coalesce(F.col(f"n.{vector}"), F.col("ov")).alias(vector), F.map_from_entries(F.concat(kept, fresh)).alias(payload))


def scan(spark: SparkSession, path: str, key: str | None = None, value=None, order: Sequence[str] = ()) -> DataFrame:
    """A table, one key's rows, in order; columns added later are read as null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if key is not None:
        df = df.where(F.col(key) == value)
    return df.orderBy(*order) if order else df
