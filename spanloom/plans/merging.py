"""Queries of merging, titles, marks, clusters and JSON recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering
from ..operators import merging as mg
from ..sources.tables import table
from .derived import register

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


@query("""WITH k AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || floor(v)::BIGINT, ',' ORDER BY event_type) AS state, (SELECT count(*) FROM events e WHERE e.user_id = k.user_id) AS n FROM k GROUP BY 1""")
def reducer_merge(spark, sf_dir):
    """Every user's events folded: ids appended, values merged by type with later ones winning."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.array("event_id").alias("ids"), F.create_map("event_type", F.floor("value")).alias("m"), "event_type")
    s = mg.folded_state(e, "user_id", "o", "ids", "m", "event_type")
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))))
    return s.select("user_id", F.array_join(pairs, ",").alias("state"), F.size("ids").cast("long").alias("n"))


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, lower(trim(source)) AS source FROM documents GROUP BY 2")
def distinct_names(spark, sf_dir):
    """The first document of every source, names compared without case."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source")).alias("source"))
    return mg.distinct_ignoring_case(d, "source", "doc_id").select("doc_id", F.lower(F.trim("source")).alias("source"))


@query("SELECT event_type AS kind, event_id AS id FROM events WHERE event_type IN ('view', 'click') AND event_id % 2 = 0 UNION ALL SELECT event_type, event_id FROM events WHERE event_id % 2 = 1 AND event_type NOT IN (SELECT event_type FROM events WHERE event_type IN ('view', 'click') AND event_id % 2 = 0)")
def planner_union(spark, sf_dir):
    """One plan's rows, and the other's of kinds that it lacks."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    return mg.union_of_absent(e.where("kind IN ('view', 'click') AND id % 2 = 0"), e.where("id % 2 = 1"), "kind")


@query("SELECT event_type AS key, round(avg(floor(value)), 4) AS mean FROM events GROUP BY 1")
def bias_means(spark, sf_dir):
    """The mean of every key over a table of maps."""
    return mg.mean_per_key(table(spark, sf_dir, "events").select(F.create_map("event_type", F.floor("value")).alias("m")), "m")


@query(r"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations), c AS (SELECT conv_id, w, count(*) AS n FROM w GROUP BY 1, 2),
k AS (SELECT conv_id, string_agg(w, ', ' ORDER BY n DESC, w) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) AS r FROM c) WHERE r <= 3 GROUP BY 1)
SELECT conv_id, coalesce(title, nullif(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:8], ' '), ''), 'Untitled section') AS title FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) LEFT JOIN k USING (conv_id)""")
def chapter_titles(spark, sf_dir):
    """A title for every conversation from its most frequent longer words."""
    t = table(spark, sf_dir, "conversations")
    words = t.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w"))
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return mg.titles(words, "conv_id", "w", first, "text").select("conv_id", "title")


@query("SELECT event_id, list_value(event_id % 60 * 60 + event_id % 7, 3600 + event_id % 60 * 60) AS marks FROM events")
def answer_marks(spark, sf_dir):
    """Times cited in generated answers."""
    i = F.col("event_id")
    text = F.format_string("see [%02d:%02d] and [1:%02d:00], not [x] or 9:99", i % 60, i % 7, i % 60)
    return table(spark, sf_dir, "events").select("event_id", mg.time_marks(text).alias("marks"))


@query("""WITH s AS (SELECT user_id, event_type, round((0.45::DOUBLE + 0.55::DOUBLE * value / 500) / (1 + 0.35::DOUBLE * (event_id % 5)) * CASE WHEN event_type = 'view' THEN 1.25::DOUBLE ELSE 1 END, 6) AS score FROM events),
b AS (SELECT user_id, event_type, max(score) AS score FROM s GROUP BY 1, 2) SELECT user_id, event_type, score, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type))::INT AS place FROM b QUALIFY place <= 4""")
def frame_ranking(spark, sf_dir):
    """The four best frames of every user's hits."""
    e = table(spark, sf_dir, "events").withColumn("q", F.col("value") / 500).withColumn("r", F.col("event_id") % 5 + 1)
    return mg.best_frames(e, "user_id", "event_type", "r", "q", F.col("event_type") == "view")


@query()
def vector_clusters(spark, sf_dir):
    """Ten clusters of all vectors: seeded k-means, the best of eight runs by inertia."""
    rows = table(spark, sf_dir, "embeddings").withColumn("all", F.lit(0))
    found = clustering.kmeans(rows, "all", "vec_id", "embedding", 10)
    return found.select("vec_id", "cluster", F.round("inertia", 6).alias("inertia"))


#: Consecutive vectors that count as one recording.
RECORDING = 250


@query()
def speaker_clusters(spark, sf_dir):
    """Speakers of every recording (each 250 consecutive vectors as its segments) by spectral clustering, named as they first speak."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull()).withColumn("recording", F.floor(F.col("vec_id") / RECORDING))
    return clustering.speakers(rows, "recording", "vec_id", "embedding")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_recovery(spark, sf_dir):
    """Properties read from text around them, with a trailing comma."""
    broken = F.concat(F.lit("Sure, here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(mg.recovered_json_column(broken), "$.k").cast("long").alias("k"))
