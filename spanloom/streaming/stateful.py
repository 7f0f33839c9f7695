"""Structured Streaming operators: event-time windows, sessions, deduplication, joins, and keyed state machines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.online import Breaker, Bucket, Ewma
from ..sources import tables
from ..sources.tables import removed_at_exit


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share; it goes when the driver ends."""
    return removed_at_exit(spark, f"{tables.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream of its files, with ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parque[t]"  # a pattern: a stream takes no single file by its name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote; complete mode keeps the last state.

    Each batch has a folder of its own by its number, so that a batch run again after a failure replaces what it wrote before.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    removed_at_exit(spark, f"{folder}-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(folder)


def tumbling_counts(events: DataFrame, width: str, key: str, watermark: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str, key: str, watermark: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, row_id: str, watermark: str | None = "1 hour") -> DataFrame:
    """The first row of each id. Without a watermark no row is late: every id is remembered, and files may come in any order."""
    if watermark is None:
        return events.dropDuplicates([row_id])
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([row_id])


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, watermark: str | None = "1 hour") -> DataFrame:
    """Pairs of a key whose right event comes at most ``within`` after the left one; both streams need ts and id columns named apart.

    Without a watermark no row is late: both sides are kept, and files may come in any order.
    """
    a, b = (left, right) if watermark is None else (left.withWatermark("l_ts", watermark), right.withWatermark("r_ts", watermark))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + F.expr(f"interval {within}")))


def _keyed(events: DataFrame, key: str, order: list[str], out: str, state: str, step) -> DataFrame:
    """Rows of each key in order through ``step(state values, rows) -> (state values, result)``; a key's state lives until the stream ends it."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        values, result = step(tuple(held.get) if held.exists else None, rows, group[0])
        held.update(values)
        yield result

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def ewma_stream(events: DataFrame, key: str, row_id: str, delta: str) -> DataFrame:
    """id, spike: jumps above a key's running level, over the stream so far."""

    def step(values, rows, name):
        s = Ewma(*values) if values else Ewma()
        spikes = [s.push(float(d)) for d in rows[delta].fillna(0.0)]
        return (s.level, s.spread, s.seen), pd.DataFrame({key: name, "id": rows[row_id], "spike": spikes})

    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ["ts", row_id], f"{key} {kind}, id long, spike double", "level double, spread double, seen int", step)


def token_bucket_stream(events: DataFrame, key: str, row_id: str, rate: float, burst: float) -> DataFrame:
    """id, passed, wait: whether each request fits its client's budget at its time."""

    def step(values, rows, name):
        b = Bucket(rate, burst, *values) if values else Bucket(rate, burst)
        got = [b.take(t.timestamp()) for t in rows["ts"]]
        return (float(b.tokens), float(b.at)), pd.DataFrame({key: name, "id": rows[row_id], "passed": [g[0] for g in got], "wait": [g[1] for g in got]})

    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ["ts", row_id], f"{key} {kind}, id long, passed boolean, wait double", "tokens double, at double", step)


def breaker_stream(events: DataFrame, key: str, row_id: str, failed: str, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """id, allowed, state: a circuit breaker per key that sees the outcome of every call it lets through."""

    def step(values, rows, name):
        b = Breaker(threshold, cooldown, *values) if values else Breaker(threshold, cooldown)
        out = []
        for t, bad in zip(rows["ts"], rows[failed], strict=True):
            now = t.timestamp()
            state, allowed = b.state(now), b.allow(now)
            if allowed:
                b.record(now, not bad)
            out.append((allowed, state))
        return (b.failures, float(b.opened), b.probing), pd.DataFrame({key: name, "id": rows[row_id], "allowed": [o[0] for o in out], "state": [o[1] for o in out]})

    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ["ts", row_id], f"{key} {kind}, id long, allowed boolean, state string", "failures int, opened double, probing boolean", step)


def bounded_queue_stream(events: DataFrame, key: str, row_id: str, capacity: int = 256) -> DataFrame:
    """key, held, dropped: a drop-oldest queue per subscriber after each batch."""

    def step(values, rows, name):
        held, dropped = values or ("", 0)
        ids = ([int(x) for x in held.split(",")] if held else []) + rows[row_id].tolist()
        over = max(0, len(ids) - capacity)
        ids, dropped = ids[over:], dropped + over
        return (",".join(map(str, ids)), dropped), pd.DataFrame({key: [name], "held": [len(ids)], "dropped": [dropped]})

    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ["ts", row_id], f"{key} {kind}, held long, dropped long", "held string, dropped long", step)
