"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that carries it to its target share. A document's number of
copies is the inverse of that Poisson distribution at a uniform number hashed from a seed and the whole row,
so runs agree whatever the partitioning, and rows with null or equal ids are drawn one by one. Rows that are equal in
all columns are counted first and drawn by their number in that count. Copies are exploded and shuffled globally by a hash
of row and copy number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Up to this many sources the rates are broadcast (a distribution of at most about 500 numbers each); beyond, a salted join.
BROADCAST_SOURCES = 1_000
#: Salts of the join beyond that, so that one source's rows spread over so many tasks.
SALTS = 64
#: A Poisson variable of a larger mean is drawn as a sum of equal parts, each with its own hash.
LARGEST_MEAN = 64.0
#: Shares go as the size of a source to this power: 1 keeps the proportions, 0 makes all sources equal.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Up to this many texts of repeated rows are told apart by a broadcast of their digests (about 100 bytes each).
BROADCAST_ROWS = 100_000
#: Draws and copies of a group of equal rows are dealt out in blocks of so many.
DEAL = 1_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits, hashed from the parts; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to far beyond the mean."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.exp(-mean)
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
    )
    return step["c"]


def source_rates(df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size_col: str | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """Per source: key, mass, rate. rate times mass is the target share of ``epochs`` times all mass.

    Mass is the number of documents, or the sum of ``size_col``. Without ``weights`` shares go as
    mass to the power ``temperature``; with them, sources that they do not name get none. A null
    source is a source of its own, named by the empty string. A source without mass has rate 0.
    """
    mass = F.count(F.lit(1)) if size_col is None else F.coalesce(F.sum(F.greatest(F.col(size_col), F.lit(0))), F.lit(0))
    stats = df.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("key")).agg(mass.cast("double").alias("mass"))
    if weights is None:
        stats = stats.withColumn("weight", F.when(F.col("mass") > 0, F.pow("mass", F.lit(temperature))).otherwise(0.0))
    else:
        named = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "key string, weight double")
        stats = stats.join(named, "key", "left").fillna(0.0, ["weight"])
    total = stats.agg(F.sum("mass").alias("m"), F.sum(F.when(F.col("mass") > 0, F.col("weight"))).alias("w")).first()
    m, w = total["m"] or 0.0, total["w"] or 0.0
    rate = F.when((F.col("mass") > 0) & F.lit(w > 0), F.lit(epochs * m) * F.col("weight") / F.lit(w or 1.0) / F.col("mass")).otherwise(0.0)
    return stats.select("key", "mass", rate.alias("rate"))


def row_digest(df: DataFrame) -> Column:
    """An md5 digest of the whole row, of columns in the order of their names; nulls differ from every value."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(df[c].cast("string")), F.lit("-")) for c in sorted(df.columns)]))


def draws(cdf: Column, parts: Column, seed: str, row: Column, nth: Column) -> Column:
    """The number of copies of the nth of the rows with this digest: a sum of ``parts`` inverted uniform numbers."""
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, k: acc + F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), row, nth, k))))


def poisson_mix(df: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, out: Sequence[str] | None = None, copy_col: str = "copy") -> DataFrame:
    """Every document as often as its Poisson count says, in a global random order, with ``copy_col`` from 1.

    Returns the columns ``out`` (all by default); an input column named as ``copy_col`` gives way. Other columns may have any name.
    Ids may be null or repeated: a row's draw hashes all its columns. Of m rows that are equal in all of them
    each has its own draw, and their copies are numbered through. Null sources count as the source ''. Empty tables stay empty.
    """
    names = [c for c in (out or df.columns) if c != copy_col]
    # positions instead of names, so that no column of the input can clash
    docs = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(df[source_col].cast("string"), F.lit("")).alias("key"), row_digest(df).alias("row"))
    columns = [f"c{i}" for i in range(len(names))]
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    r = rates.select("key", parts.alias("parts"), distribution(F.col("rate") / parts).alias("cdf"))
    few = rates.select("key").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def rated(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(r), "key")
        salted = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])

    again = checkpointed(docs.groupBy("row").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    many = again.count()
    mark = F.broadcast(again.select("row")) if many <= BROADCAST_ROWS else again.select("row")
    alone = docs.join(mark, "row", "left_anti") if many else docs
    counted = rated(alone).withColumn("n", draws(F.col("cdf"), F.col("parts"), seed, F.col("row"), F.lit(1))).where("n > 0")
    copies = counted.select(*columns, "row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    if many:
        # one row stands for its equals; only digests are drawn for, in blocks that spread over tasks
        one = docs.join(mark, "row", "left_semi").dropDuplicates(["row"])
        blocks = one.select("row", "key").join(again, "row").select("row", "key", "m", F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {DEAL}"))).alias("block")).repartition("row", "block")
        each = F.sequence(F.col("block") * DEAL + 1, F.least(F.col("m"), (F.col("block") + 1) * DEAL))
        drawn = rated(blocks).select("row", F.aggregate(each, F.lit(0).cast("long"), lambda acc, nth: acc + draws(F.col("cdf"), F.col("parts"), seed, F.col("row"), nth)).alias("n"))
        totals = drawn.groupBy("row").agg(F.sum("n").alias("n")).where("n > 0")
        dealt = totals.select("row", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {DEAL}"))).alias("block")).repartition("row", "block")
        numbers = F.sequence(F.col("block") * DEAL + 1, F.least(F.col("n"), (F.col("block") + 1) * DEAL))
        copies = copies.unionByName(dealt.join(one, "row").select(*columns, "row", F.explode(numbers.cast("array<int>")).alias("copy")))
    place = F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.col("row"), F.col("copy").cast("string")))
    placed = copies.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    return placed.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col("copy").alias(copy_col))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to shares of the root of their sources' sizes; nulls and repeated rows as in poisson_mix."""
    docs = table(spark, sf_dir, "documents")
    return poisson_mix(docs, source_rates(docs))


ORACLE_SQL = f"""
WITH RECURSIVE stats AS (
  SELECT coalesce(source, '') AS key, count(*)::DOUBLE AS mass, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY 1
), rates AS (
  SELECT key, (SELECT sum(mass) FROM stats) * weight / (SELECT sum(weight) FROM stats) / mass AS rate FROM stats
), means AS (
  SELECT key, greatest(1, ceil(rate / {LARGEST_MEAN}))::INT AS parts, rate / greatest(1, ceil(rate / {LARGEST_MEAN}))::INT AS mean FROM rates
), cdf(key, parts, mean, k, p, c) AS (
  SELECT key, parts, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT key, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 24)
), equal_rows AS (
  SELECT doc_id, text, lang, source, n_chars, count(*) AS m FROM documents GROUP BY ALL
), digests AS (
  SELECT *, md5(concat_ws('|', coalesce(md5(doc_id::VARCHAR), '-'), coalesce(md5(lang), '-'), coalesce(md5(n_chars::VARCHAR), '-'), coalesce(md5(source), '-'), coalesce(md5(text), '-'))) AS digest FROM equal_rows
), draws AS (
  SELECT digest, key, nth, unnest(generate_series(1, parts)) AS part
  FROM (SELECT d.digest, m.key, m.parts, unnest(generate_series(1, d.m)) AS nth FROM digests d JOIN means m ON m.key = coalesce(d.source, ''))
), numbers AS (
  SELECT digest, key, (('0x' || substr(md5('{SEED}|' || digest || '|' || nth || '|' || part), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)} AS u FROM draws
), counts AS (
  SELECT n.digest, count(*) AS n FROM numbers n JOIN cdf ON cdf.key = n.key AND cdf.c <= n.u GROUP BY n.digest
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(generate_series(1, c.n))::INT AS copy
FROM digests d JOIN counts c ON c.digest = d.digest
"""

QUERIES = {"op4_poisson_mix": op4_poisson_mix}
ORACLES = {"op4_poisson_mix": ORACLE_SQL}


def expected_rate(mass: float, weight: float, all_mass: float, all_weight: float) -> float:
    """The mean number of copies of a document, for tests and planning."""
    return all_mass * weight / all_weight / mass if mass and not math.isclose(all_weight, 0.0) else 0.0
