"""Timers: rows in shuffled files give what the batch gives, and idle state goes."""

import random

from pyspark.sql import functions as F

from spanloom.operators import sequential
from spanloom.streaming import stateful, timers


def filed(spark, folder, batches):
    """One file per batch, older ones first."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id long, id long, sec double, delta double").select("user_id", "id", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")).alias("ts"), "delta")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema("user_id long, id long, ts timestamp, delta double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_shuffled_files_give_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(u, 100 * u + i, 60.0 * i + rng.random(), rng.random() * (0.05 if rng.random() < 0.9 else 1)) for u in range(3) for i in range(40)]
    by_time = sorted(rows, key=lambda r: r[2])
    batches = [by_time[k : k + 20] for k in range(0, len(by_time), 20)]
    for b in batches:
        rng.shuffle(b)
    # neighbouring files are exchanged: rows come up to forty minutes late, within the watermark
    for k in range(0, len(batches) - 1, 2):
        batches[k], batches[k + 1] = batches[k + 1], batches[k]
    sentinel = [(99, 1, 60.0 * 40 + 4 * 3600, 0.0)]
    stream = filed(spark, str(tmp_path / "in"), [*batches, sentinel])
    got = {r.id: r.spike for r in stateful.drain(timers.ordered_ewma(stream, "user_id", "id", "delta", watermark="1 hour")).collect()}
    want = {r.id: r.spike for r in sequential.ewma_spikes(spark.createDataFrame(rows, "user_id long, id long, sec double, delta double"), "user_id", "sec", "id", "delta").collect()}
    assert got == want and any(v > 0 for v in got.values())


def test_idle_state_goes(spark, tmp_path):
    hour = 3600.0
    batches = [[(u, u, u, 0.5) for u in range(20)], [(50, 60, 3 * hour, 0.1)], [(51, 61, 30 * hour, 0.1)], [(51, 62, 60 * hour, 0.1)]]
    stream = timers.ordered_ewma(filed(spark, str(tmp_path / "in"), [[(a, b, float(c), d) for a, b, c, d in x] for x in batches]), "user_id", "id", "delta", watermark="1 hour", idle_ms=int(10 * hour * 1000))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) > 40 and kept[-1] < 15
