"""Streaming queries; each drains what is there and is compared with a batch query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import stateful as st
from ..streaming import timers
from .derived import register
from .signals import SQL_EWMA

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Daily counts per event type, kept up to date."""
    w = st.drain(st.tumbling_counts(st.event_stream(spark, sf_dir), "1 day", "event_type"), "complete")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    """Sessions of each user that end after six quiet hours."""
    s = st.drain(st.session_counts(st.event_stream(spark, sf_dir), "6 hours", "user_id"), "complete")
    return s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    """Events without repeated ids."""
    return st.drain(st.deduplicated(st.event_stream(spark, sf_dir), "event_id", None)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def stream_interval_join(spark, sf_dir):
    """Clicks within two hours of a view of the same user."""
    side = lambda kind, p: st.event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(*[F.col(c).alias(p + c) for c in ("event_id", "user_id", "ts")])
    pairs = st.drain(st.interval_join(side("view", "l_"), side("click", "r_"), "user_id", "2 hours", None))
    return pairs.select(F.col("l_event_id").alias("view_id"), F.col("r_event_id").alias("click_id"))


@query(f"WITH RECURSIVE {SQL_EWMA} SELECT user_id, id, spike FROM lv")
def stream_ewma(spark, sf_dir):
    """Jumps of each user's value, found online."""
    return st.drain(st.ewma_stream(st.event_stream(spark, sf_dir).withColumn("delta", F.col("value") / 500), "user_id", "event_id", "delta"))


@query(f"WITH RECURSIVE {SQL_EWMA} SELECT user_id, id, spike FROM lv JOIN (SELECT event_id AS id, epoch_us(ts) AS us FROM events) USING (id) WHERE us <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 3600000) * 1000")
def stream_ordered_ewma(spark, sf_dir):
    """The same with rows held back until the watermark, an hour behind, has passed them, so that they are judged in order whatever batch they come in."""
    return st.drain(timers.ordered_ewma(st.event_stream(spark, sf_dir).withColumn("delta", F.col("value") / 500), "user_id", "event_id", "delta"))


@query()
def token_bucket(spark, sf_dir):
    """Requests of each user that fit a budget of three at once and one in four hours."""
    return st.drain(st.token_bucket_stream(st.event_stream(spark, sf_dir), "user_id", "event_id", 1 / 14_400, 3.0))


@query()
def circuit_breaker(spark, sf_dir):
    """Calls that a breaker per user lets through, where errors are failures."""
    return st.drain(st.breaker_stream(st.event_stream(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), "user_id", "event_id", "failed", 2, 7200.0))


@query()
def bounded_queue(spark, sf_dir):
    """What each subscriber of an event type still holds of its queue of 256, and what it lost."""
    return st.drain(st.bounded_queue_stream(st.event_stream(spark, sf_dir), "event_type", "event_id"))


@query("SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events) WHERE back <= 512 AND event_id > 100")
def topic_ring_replay(spark, sf_dir):
    """What a subscriber gets replayed after event 100: the last 512 of each topic beyond it."""
    back = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("event_id")))
    ring = table(spark, sf_dir, "events").select("event_type", "event_id").withColumn("back", back).where("back <= 512").where("event_id > 100")
    return ring.select("event_type", "event_id", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).alias("place"))


_WEIGHTS = {"view": 2.0, "click": 6.0, "signup": 16.0, "error": 20.0, "purchase": 26.0}


@query(f"""WITH f AS (SELECT user_id, event_type, min(event_id) AS id FROM events GROUP BY 1, 2), w AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items())} END::DOUBLE AS w FROM f)
SELECT user_id, id, round(sum(w) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) / {sum(_WEIGHTS.values())}::DOUBLE, 2) AS progress FROM w""")
def progress_running(spark, sf_dir):
    """A user's weighted progress as each kind of event is first reached."""
    weight = F.create_map(*[F.lit(x) for kv in _WEIGHTS.items() for x in kv])[F.col("event_type")]
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))
    w = W.partitionBy("user_id").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    return first.select("user_id", "id", F.round(F.sum(weight).over(w) / sum(_WEIGHTS.values()), 2).alias("progress"))
