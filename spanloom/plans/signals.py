"""Queries of signal analysis over events, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scans
from ..operators import sequential as seq
from ..operators import signals as sg
from ..sources.tables import table
from .derived import SQL_SPANS, register, spans

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)
DIM = 64


def _positions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("start", "id")
    return spans(spark, sf_dir).withColumn("pos", F.row_number().over(w) - 1)


_ROBUST = f"""WITH {SQL_SPANS}, p AS (SELECT id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY "start", id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM spans),
r AS (SELECT DISTINCT id, user_id, value, pos, e FROM (SELECT *, unnest([pos + k * greatest(2 * (n - 1), 1), k * greatest(2 * (n - 1), 1) - pos]) AS e FROM p, range(-7, 8) t(k)) WHERE e >= -7 AND e < n + 7),
f AS (SELECT id, user_id, value, pos, e, list(value) OVER (PARTITION BY user_id ORDER BY e ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS l FROM r),
m AS (SELECT *, list_sort(l)[8] AS med FROM f WHERE e = pos)"""


def _robust(spark, sf_dir):
    return sg.robust_scores(_positions(spark, sf_dir).select("id", "user_id", "pos", "value"), "user_id", "pos", "value")


@query(_ROBUST + "SELECT id, med AS median FROM m")
def rolling_median(spark, sf_dir):
    """The median of fifteen values around each event of a user, mirrored at the ends."""
    return _robust(spark, sf_dir).select("id", "median")


@query(_ROBUST + "SELECT id, round((value - med) / greatest(1.4826 * list_sort(list_transform(l, lambda x: abs(x - med)))[8], 1.0::DOUBLE), 6) AS z FROM m")
def rolling_mad_z(spark, sf_dir):
    """Distance from the rolling median in robust deviations."""
    return _robust(spark, sf_dir).select("id", F.round("z", 6).alias("z"))


@query(f"""WITH {SQL_SPANS}, r AS (SELECT id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY "start", id) - 1 AS pos FROM spans)
SELECT a.id, round(a.value, 4) AS value FROM r a WHERE value >= 300 AND pos > 0""")
def cut_candidates(spark, sf_dir):
    """Events that are strong enough for a cut and not a user's first."""
    return _positions(spark, sf_dir).where((F.col("value") >= 300) & (F.col("pos") > 0)).select("id", F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS luma FROM embeddings),
d AS (SELECT vec_id, v, luma, lag(v) OVER w AS pv, lag(luma) OVER w AS pl FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, round(100 * (0.5 * list_sum(list_transform(list_zip(v, pv), lambda x: abs(x[1] - x[2]))) / 2 + 0.42 * abs(luma - pl)), 6) AS delta FROM d WHERE pv IS NOT NULL""")
def signal_delta(spark, sf_dir):
    """Change between neighbouring vectors of a label, read as frames."""
    w = W.partitionBy("label").orderBy("vec_id")
    luma = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")
    e = table(spark, sf_dir, "embeddings").withColumn("luma", luma)
    d = e.select("vec_id", "embedding", "luma", F.lag("embedding").over(w).alias("p"), F.lag("luma").over(w).alias("pl")).where("p is not null")
    return d.select("vec_id", F.round(sg.frame_delta(F.col("embedding"), F.col("p"), F.col("luma"), F.col("pl")), 6).alias("delta"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
s AS (SELECT strftime(month, '%Y-%m') AS month, total, lag(total) OVER (ORDER BY month) AS p, first_value(total) OVER (ORDER BY month) AS f, row_number() OVER (ORDER BY month) AS k FROM m)
SELECT month, total, round(total - p, 2) AS delta, round((total - p) / p * 100, 4) AS growth, round((total - f) / f * 100, 4) AS overall, CASE WHEN k > 1 THEN round((pow(total / f, 1.0::DOUBLE / (k - 1)) - 1) * 100, 4) END AS cagr FROM s""")
def pairwise_growth(spark, sf_dir):
    """Monthly order totals with change, growth, growth since the start and its compound rate."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    w = W.orderBy("month")  # one row per month: a bounded window
    s = m.select("month", "total", F.lag("total").over(w).alias("p"), F.first("total").over(w).alias("f"), F.row_number().over(w).alias("k"))
    t, p, f = F.col("total"), F.col("p"), F.col("f")
    cagr = F.when(F.col("k") > 1, F.round((F.pow(t / f, 1.0 / (F.col("k") - 1)) - 1) * 100, 4))
    return s.select("month", "total", F.round(t - p, 2).alias("delta"), F.round((t - p) / p * 100, 4).alias("growth"), F.round((t - f) / f * 100, 4).alias("overall"), cagr.alias("cagr"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, user_id FROM events),
v AS (SELECT user_id, idx, idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS step FROM r WHERE value > 60),
i AS (SELECT user_id, idx, sum(CASE WHEN step IS NULL OR step > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM v)
SELECT user_id, min(idx)::INT AS first, max(idx)::INT AS last, count(*) AS n FROM i GROUP BY user_id, k HAVING count(*) >= 2""")
def vad_islands(spark, sf_dir):
    """Stretches of loud frames per user, with silences of at most four frames closed, of two loud frames or more."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    loud = table(spark, sf_dir, "events").withColumn("idx", F.row_number().over(w)).where("value > 60")
    return sg.islands(loud, "user_id", "idx", 5).where("n >= 2")


_COHESION = """WITH e AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9)) AS u,
row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
x AS (SELECT label, pos, unnest(u) AS v, generate_subscripts(u, 1) AS d FROM e),
s AS (SELECT label, pos, d, sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l, sum(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM x WINDOW w AS (PARTITION BY label, d ORDER BY pos)),
c AS (SELECT label, pos AS gap, sum(l * r) / (greatest(sqrt(sum(l * l)), 1e-9) * greatest(sqrt(sum(r * r)), 1e-9)) AS c FROM s WHERE r IS NOT NULL GROUP BY 1, 2)"""


def _cohesion(spark, sf_dir):
    return sg.cohesion(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", DIM)


@query(_COHESION + "SELECT label, gap::INT AS gap, round(c, 6) AS cohesion FROM c")
def cohesion(spark, sf_dir):
    """Likeness of the vectors before and after every gap of a label."""
    return _cohesion(spark, sf_dir).select("label", "gap", F.round("cohesion", 6).alias("cohesion"))


@query(_COHESION + """, q AS (SELECT label, gap, round(c, 6) AS s FROM c),
f AS (SELECT *, CASE WHEN lag(s) OVER w >= s THEN 0 ELSE 1 END AS fl, CASE WHEN lead(s) OVER w >= s THEN 0 ELSE 1 END AS fr FROM q WINDOW w AS (PARTITION BY label ORDER BY gap)),
k AS (SELECT *, sum(fl) OVER (PARTITION BY label ORDER BY gap ROWS UNBOUNDED PRECEDING) AS kl, sum(fr) OVER (PARTITION BY label ORDER BY gap DESC ROWS UNBOUNDED PRECEDING) AS kr FROM f),
d AS (SELECT label, gap, max(s) OVER (PARTITION BY label, kl) - s + max(s) OVER (PARTITION BY label, kr) - s AS depth FROM k),
t AS (SELECT *, avg(depth) OVER (PARTITION BY label) + 0.55 * stddev_pop(depth) OVER (PARTITION BY label) AS lim, max(depth) OVER (PARTITION BY label ORDER BY gap ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS most FROM d)
SELECT label, gap::INT AS gap, round(depth, 6) AS depth, depth > lim AND depth > 1e-6 AND depth >= most AS picked FROM t""")
def depth_boundaries(spark, sf_dir):
    """Topic boundaries: gaps whose cohesion lies deep below the peaks around."""
    rounded = _cohesion(spark, sf_dir).withColumn("cohesion", F.round("cohesion", 6))
    deep = sg.depth_boundaries(sg.depth(rounded, "label", "gap", "cohesion"), "label", "gap")
    return deep.select("label", "gap", F.round("depth", 6).alias("depth"), "picked")


@query(f"""WITH {SQL_SPANS}, d AS (SELECT id, user_id, sqrt(greatest(value, 0.25)) * (0.35 + value / 500) * (1.15 - (kind = 'view')::INT) AS d, 2 * count(*) OVER (PARTITION BY user_id) AS budget, count(*) OVER (PARTITION BY user_id) AS n FROM spans),
x AS (SELECT *, (budget - n) * d / sum(d) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM d),
w AS (SELECT *, floor(x) AS w FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x - w DESC, id) AS place, budget - n - sum(w) OVER (PARTITION BY user_id) AS rest FROM w)
SELECT user_id, sum(w + (place <= rest)::INT + 1)::BIGINT AS total, count(*) AS n FROM p GROUP BY 1""")
def budget_apportion(spark, sf_dir):
    """Twice as many frames as a user has spans, dealt by largest remainders; checked by its totals, as last bits decide single remainders."""
    demand = F.sqrt(F.greatest("value", F.lit(0.25))) * (0.35 + F.col("value") / 500) * (1.15 - (F.col("kind") == "view").cast("int"))
    s = spans(spark, sf_dir)
    dealt = sg.apportion(s, "user_id", "id", demand, 2 * F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return dealt.groupBy("user_id").agg(F.sum("share").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_SPANS}, b AS (SELECT kind, value, unnest(generate_series(floor("start" / 3600)::BIGINT, floor("end" / 3600)::BIGINT)) AS bucket FROM spans),
m AS (SELECT kind, bucket, max(value) AS top FROM b GROUP BY 1, 2) SELECT kind, bucket, round(top / max(top) OVER (PARTITION BY kind), 6) AS level FROM m""")
def bucketed_activity(spark, sf_dir):
    """The strongest span of each hour and type, as a share of the type's strongest."""
    hours = F.sequence(F.floor(F.col("start") / 3600), F.floor(F.col("end") / 3600))
    top = spans(spark, sf_dir).select("kind", "value", F.explode(hours).alias("bucket")).groupBy("kind", "bucket").agg(F.max("value").alias("top"))
    most = top.groupBy("kind").agg(F.max("top").alias("most"))
    return top.join(most, "kind").select("kind", "bucket", F.round(F.col("top") / F.col("most"), 6).alias("level"))


#: Running level and spread along each user's events, one row after the other.
SQL_EWMA = f"""{SQL_SPANS}, e AS (SELECT user_id, id, "start", value / 500 AS d, row_number() OVER (PARTITION BY user_id ORDER BY "start", id) AS k FROM spans),
lv AS (SELECT user_id, id, k, 0::DOUBLE AS spike, 0.05::DOUBLE * d AS level, 0.05::DOUBLE * abs(d - 0.05::DOUBLE * d) AS spread FROM e WHERE k = 1
  UNION ALL SELECT user_id, e.id, e.k, CASE WHEN e.k > 12 AND d > level + 6 * spread + 0.02::DOUBLE THEN least(1, 4 * d) ELSE 0 END, level + 0.05::DOUBLE * (d - level),
    spread + 0.05::DOUBLE * (abs(d - (level + 0.05::DOUBLE * (d - level))) - spread) FROM lv JOIN e USING (user_id) WHERE e.k = lv.k + 1)"""


@query(f"WITH RECURSIVE {SQL_EWMA} SELECT user_id, id, spike FROM lv")
def ewma_spikes(spark, sf_dir):
    """Jumps of an event's value above the running level of its user."""
    e = scans.numbered(spans(spark, sf_dir).select("user_id", "start", "id", (F.col("value") / 500).alias("delta")), "user_id", ["start", "id"])
    return scans.spikes(e, "user_id", "id", "delta").select("user_id", "id", "spike")


@query(f"""WITH RECURSIVE {SQL_EWMA}, w AS (SELECT user_id, greatest(0.25, (max("start") - min("start")) / 40) AS w FROM spans GROUP BY 1),
j AS (SELECT e.user_id, e.id, e.k, e."start" AS t, d, spike, w FROM e JOIN lv USING (user_id, k) JOIN w USING (user_id)),
s AS (SELECT *, TRUE AS kept, t + w AS due FROM j WHERE k = 1
  UNION ALL SELECT j.*, j.t + 1e-6 >= s.due OR j.spike > 0, CASE WHEN j.t + 1e-6 >= s.due OR j.spike > 0 THEN j.t + j.w ELSE s.due END FROM s JOIN j USING (user_id) WHERE j.k = s.k + 1)
SELECT user_id, id, spike, round(greatest(100 * d, 100 * spike), 6) AS signal FROM s WHERE kept""")
def adaptive_frames(spark, sf_dir):
    """Of each user's events as frames: a grid of about forty over their whole length, and every jump above the running level."""
    e = spans(spark, sf_dir).select("user_id", "start", "id", (F.col("value") / 500).alias("delta"))
    kept = scans.adaptive_samples(e, "user_id", "start", "id", "delta", target=40)
    return kept.select("user_id", "id", "spike", F.round("signal", 6).alias("signal"))


@query()
def select_cuts(spark, sf_dir):
    """The strongest events of each user that are a day or more apart."""
    return seq.select_cuts(spans(spark, sf_dir), "user_id", "start", "id", "value", 86_400.0)


@query()
def optimal_cuts(spark, sf_dir):
    """Cuts of each user's events into stretches of about five days, preferably at strong events."""
    return seq.optimal_cuts(spans(spark, sf_dir).withColumn("q", F.least(F.col("value") / 500, F.lit(1.0))), "user_id", "start", "q", 5 * 86_400.0, 10 * 86_400.0)


@query(f"""WITH RECURSIVE {SQL_SPANS}, e AS (SELECT user_id, id, "start" AS t, row_number() OVER (PARTITION BY user_id ORDER BY "start", id) AS k FROM spans),
s AS (SELECT *, TRUE AS kept, t AS last FROM e WHERE k = 1
  UNION ALL SELECT e.*, e.t + 1e-6 >= s.last + 21600, CASE WHEN e.t + 1e-6 >= s.last + 21600 THEN e.t ELSE s.last END FROM s JOIN e USING (user_id) WHERE e.k = s.k + 1)
SELECT user_id, id, t FROM s WHERE kept""")
def grid_thinning(spark, sf_dir):
    """Events of each user at least six hours after the last one kept."""
    e = scans.numbered(spans(spark, sf_dir).select("user_id", "start", "id"), "user_id", ["start", "id"])
    return scans.thinned(e, "user_id", "start", "id", 6 * 3600.0).drop("spike")
