"""Queries of the composites: chunks, chapters, evidence, statistics over arrays, display forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import programs, text as tx
from ..operators import assembly as asm
from ..operators import bm25
from ..operators import sequential as seq
from ..operators import signals as sg
from ..sources.tables import table
from .derived import SQL_CHUNKS, SQL_SPANS, chunks, register, spans

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


def _segments(spark, sf_dir):
    """Conversations as segments of a recording: ten seconds a turn, with a second of silence."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), (F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 9).cast("double").alias("end"), F.col("role").alias("speaker"), "text")


@query()
def chunk_building(spark, sf_dir):
    """Conversations cut into chunks at natural boundaries, with their text, speakers and speech rate."""
    s = _segments(spark, sf_dir)
    scenes = s.where("idx % 4 = 0").select("video_id", "start")
    return asm.chunk_contents(asm.chunk_spans(s, scenes), s)


@query()
def topic_segmentation(spark, sf_dir):
    """Vectors of each label grouped into chapters at deep gaps that leave two rows on both sides."""
    e = table(spark, sf_dir, "embeddings")
    deep = sg.depth_boundaries(sg.depth(sg.cohesion(e, "label", "vec_id", "embedding", 64), "label", "gap", "cohesion"), "label", "gap")
    cuts = asm.accepted_cuts(deep, "label", "gap", "picked")
    rows = e.select("label", "vec_id", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("idx"))
    return asm.chapters_of(rows, cuts, "label", "idx", "gap")


@query()
def scene_detection(spark, sf_dir):
    """Cuts of each user's signal where it stands out from its surroundings, scheduled an hour apart, as scenes."""
    w = W.partitionBy("user_id").orderBy("start", "id")
    s = spans(spark, sf_dir).withColumn("pos", F.row_number().over(w) - 1)
    z = sg.robust_scores(s.select("user_id", "id", "start", "pos", "value"), "user_id", "pos", "value")
    strong = z.where(((F.col("value") >= 270) | ((F.col("z") >= 3.2) & (F.col("value") >= 121.5))) & (F.col("pos") > 0))
    return seq.select_cuts(strong, "user_id", "start", "id", "value", 3600.0)


@query(f"""WITH {SQL_SPANS}, s AS (SELECT id, kind, "start", "end" FROM spans), f AS (SELECT id, kind, "start" AS t FROM spans WHERE id % 3 = 0)
SELECT s.id, coalesce((SELECT string_agg(f.id::VARCHAR, ',' ORDER BY f.t, f.id) FROM f WHERE f.kind = s.kind AND s."start" <= f.t AND f.t < s."end"),
  (SELECT f.id::VARCHAR FROM f WHERE f.kind = s.kind ORDER BY abs(f.t - (s."start" + s."end") / 2), f.t, f.id LIMIT 1)) AS frames FROM s""")
def frames_of_chunks(spark, sf_dir):
    """For every span the frames (every third event of the type) inside it, or else the nearest."""
    s = spans(spark, sf_dir)
    whole = s.select("kind", F.col("id").alias("idx"), "start", "end")
    frames = s.where("id % 3 = 0").select("kind", F.col("start").alias("t"), "id")
    return asm.frames_of_spans(whole, frames, "kind", 3600.0).select(F.col("idx").alias("id"), F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("WITH c AS (SELECT o_orderkey AS parent, o_custkey AS child FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders) SELECT child, max(parent) AS parent FROM c GROUP BY 1")
def child_parent_links(spark, sf_dir):
    """Customers listed by several orders belong to the last of them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.array("o_custkey", F.col("o_custkey") + 1).alias("children"), F.col("o_orderkey").alias("k"))
    return asm.parent_links(o, "children", "child", "parent", "k")


@query(f"WITH {SQL_CHUNKS} SELECT a.doc_id, count(b.doc_id) AS n, sum(b.doc_id)::BIGINT AS ids FROM chunks a JOIN chunks b ON a.video_id = b.video_id AND abs(a.idx - b.idx) <= 2 AND a.idx <> b.idx GROUP BY 1")
def chunk_neighbours(spark, sf_dir):
    """The chunks up to two places away."""
    n = asm.neighbours(chunks(spark, sf_dir).select("video_id", "idx", "doc_id"), "video_id", "idx", "doc_id", 2)
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("ids"))


@query(r"""WITH t AS (SELECT conv_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM conversations)
SELECT conv_id, count(*) AS segments, sum(w)::BIGINT AS words, count(*) * 9.0::DOUBLE AS speech_seconds, round(sum(w) / (count(*) * 9.0::DOUBLE / 60), 1) AS wpm FROM t GROUP BY 1""")
def transcript_stats(spark, sf_dir):
    """Segments, words, speech and words per minute of every conversation."""
    s = _segments(spark, sf_dir).withColumn("w", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    speech = F.sum(F.col("end") - F.col("start"))
    g = s.groupBy(F.col("video_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("segments"), F.sum("w").alias("words"), F.round(speech, 2).alias("speech_seconds"))
    return g.withColumn("wpm", F.when(F.col("speech_seconds") > 1, F.round(F.col("words") / (F.col("speech_seconds") / 60), 1)).otherwise(0.0))


@query("""WITH b AS (SELECT event_type, least(floor(value / 50), 9)::INT AS bin, sum(value) AS w FROM events GROUP BY 1, 2), p AS (SELECT event_type, bin, w / sum(w) OVER (PARTITION BY event_type) AS p FROM b)
SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS bins FROM p GROUP BY 1""")
def histogram_entropy(spark, sf_dir):
    """Entropy of each type's weighted histogram of values."""
    b = table(spark, sf_dir, "events").groupBy("event_type", F.least(F.floor(F.col("value") / 50), F.lit(9)).alias("bin")).agg(F.sum("value").alias("w"))
    p = b.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("event_type")))
    return p.groupBy("event_type").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.count(F.lit(1)).alias("bins"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.92), 6) AS p92, approx_count_distinct(1) AS one FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    """Interpolated percentiles of each type's values."""
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.1).alias("p10"), p(0.9).alias("p90"), p(0.92).alias("p92"), F.approx_count_distinct(F.lit(1)).alias("one"))


@query("WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label, d::INT AS d, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY 1, 2")
def pooled_vectors(spark, sf_dir):
    """Mean and deviation of every dimension per label."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    return x.groupBy("label", (F.col("d") + 1).alias("d")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")), 6).alias("std"))


@query("SELECT event_id, round(CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p ELSE (n - p) / 2 END, 6) AS delta FROM (SELECT event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def delta_features(spark, sf_dir):
    """The central gradient of each user's values."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(w).alias("p"), F.lead("value").over(w).alias("n"))
    d = F.when(F.col("p").isNull(), F.col("n") - F.col("value")).when(F.col("n").isNull(), F.col("value") - F.col("p")).otherwise((F.col("n") - F.col("p")) / 2)
    return e.select("event_id", F.round(d, 6).alias("delta"))


@query("""WITH g AS (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi, sum(value) OVER (PARTITION BY user_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r FROM events)
SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1 END, 6) AS scaled, round(value / s, 6) AS share, round(1 / (1 + 0.4::DOUBLE * r), 6) AS decay FROM g""")
def scaled_shares(spark, sf_dir):
    """Each value scaled within its user, its share of the total, and a weight that fades with its rank."""
    w = W.partitionBy("user_id")
    r = F.row_number().over(w.orderBy(F.desc("value"), "event_id")) - 1
    e = table(spark, sf_dir, "events").withColumn("r", r)
    return e.select("event_id", F.round(asm.minmax("value", "user_id"), 6).alias("scaled"), F.round(F.col("value") / F.sum("value").over(w), 6).alias("share"), F.round(asm.rank_decay(F.col("r"), 0.4), 6).alias("decay"))


@query(f"""WITH {SQL_SPANS}, n AS (SELECT *, lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM spans WINDOW w AS (PARTITION BY kind ORDER BY "start", id)),
o AS (SELECT *, greatest(least("end", e2) - greatest("start", s2), 0) AS o FROM n WHERE s2 IS NOT NULL)
SELECT id, round(o, 3) AS overlap, round(o / (("end" - "start") + (e2 - s2) - o), 6) AS iou, round(exp(greatest(-6, least(0, -value / 100))) * 0.9::DOUBLE, 4) AS confidence FROM o""")
def interval_scalars(spark, sf_dir):
    """Overlap and likeness of neighbouring spans of a type, and a confidence from a log-probability."""
    w = W.partitionBy("kind").orderBy("start", "id")
    n = spans(spark, sf_dir).withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w)).where("s2 is not null")
    overlap = F.greatest(F.least("end", "e2") - F.greatest("start", "s2"), F.lit(0.0))
    iou = asm.interval_iou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))
    return n.select("id", F.round(overlap, 3).alias("overlap"), F.round(iou, 6).alias("iou"), asm.speech_confidence(-F.col("value") / 100, F.lit(0.1)).alias("confidence"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 10 OR floor((i + 1) * 10 / n) - floor(i * 10 / n) >= 1")
def uniform_downsample(spark, sf_dir):
    """Ten evenly spread events of every user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.struct("ts", "event_id"))
    return asm.uniform_sample(e, "user_id", "k", 10).select("event_id")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey))::INT AS turn FROM orders WHERE o_orderstatus = 'P'")
def priority_queue(spark, sf_dir):
    """The order in which open orders would be worked off, smallest first."""
    return asm.job_order(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_totalprice", "o_orderkey").select("o_orderkey", "turn")


_TIMES = ("what came after 1:30", "from 01:02:03 on", "before 10:00 please", "until 1:00:00", "no time here", "the second speaker", "what did the last person say", "third presenter since 0:45")
_VALUES = ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(_TIMES))


@query(f"""WITH q AS (SELECT * FROM (VALUES {_VALUES}) v(id, t) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations), m AS (SELECT *, regexp_extract(t, '(?i)\\b(?:after|from|since)\\s+(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?)', 1) AS a, regexp_extract(t, '(?i)\\b(?:before|until|up to)\\s+(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?)', 1) AS b,
lower(regexp_extract(t, '(?i)\\b(first|1st|second|2nd|third|3rd|fourth|4th|fifth|5th|last|final)\\s+(?:speaker|person|presenter|panelist|voice)\\b', 1)) AS o FROM q),
s AS (SELECT *, list_reduce(list_transform(string_split(nullif(a, ''), ':'), lambda x: x::BIGINT), lambda x, y: x * 60 + y)::DOUBLE AS sa, list_reduce(list_transform(string_split(nullif(b, ''), ':'), lambda x: x::BIGINT), lambda x, y: x * 60 + y)::DOUBLE AS sb FROM m)
SELECT id, CASE WHEN sa IS NOT NULL THEN sa WHEN sb IS NOT NULL THEN 0 END AS start_s, CASE WHEN sa IS NOT NULL THEN 1e6 ELSE sb END AS end_s,
CASE o WHEN 'first' THEN 'Ann' WHEN 'second' THEN 'Bob' WHEN 'third' THEN 'Cy' WHEN 'last' THEN 'Cy' END AS speaker FROM s""")
def time_and_speaker_references(spark, sf_dir):
    """Ranges and speakers that all turns of the conversations, and some fixed questions, name."""
    fixed = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_TIMES)], "id long, t string")
    q = fixed.unionByName(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t")))
    r = asm.time_filter(F.col("t"))
    who = asm.ordinal_speaker(F.col("t"), F.array(F.lit("Cy"), F.lit("Ann"), F.lit("Bob")))
    return q.select("id", r["start"].alias("start_s"), r["end"].alias("end_s"), who.alias("speaker"))


@query("SELECT DISTINCT source, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(source, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 8 AS slot FROM documents")
def colour_slots(spark, sf_dir):
    """A steady colour slot for every source."""
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", asm.hue_slot(F.col("source")).alias("slot"))


_WHOLE = lambda v, unit: f"printf('%.0f {unit}', floor({v} + 0.5))"
_TENTH = lambda v, unit: f"printf('%.1f {unit}', floor({v} * 10 + 0.5) / 10)"


@query(f"""SELECT o_orderkey, CASE WHEN p < 1024 THEN {_WHOLE('p', 'B')} WHEN p / 1024 < 100 THEN {_TENTH('p / 1024', 'KB')} WHEN p / 1024 < 1024 THEN {_WHOLE('p / 1024', 'KB')} ELSE {_TENTH('p / 1048576', 'MB')} END AS bytes,
CASE WHEN d >= 3600 THEN {_TENTH('d / 3600', 'h')} WHEN d >= 60 THEN {_WHOLE('d / 60', 'min')} ELSE {_WHOLE('d', 's')} END AS duration FROM (SELECT o_orderkey, floor(o_totalprice * 13.7::DOUBLE) AS p, floor(o_totalprice / 97) AS d FROM orders)""")
def human_formats(spark, sf_dir):
    """Sizes and durations as people read them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 13.7).cast("double").alias("p"), F.floor(F.col("o_totalprice") / 97).cast("double").alias("d"))
    return o.select("o_orderkey", asm.human_bytes(F.col("p")).alias("bytes"), asm.human_duration(F.col("d")).alias("duration"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS value FROM lineitem")
def analyst_program(spark, sf_dir):
    """A program of an analyst, checked against the allow-list and run as an expression."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", programs.program("round(l_extendedprice * (1 - l_discount), 4)", li.columns).alias("value"))


@query()
def text_sketches(spark, sf_dir):
    """A hashed unit vector for every passage."""
    return table(spark, sf_dir, "benchmark").select("item_id", programs.sketch_column(F.col("text")).alias("vec"))


def _hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = bm25.top(docs, table(spark, sf_dir, "benchmark"), 8)
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, "[.,!?;:]+$", "")), lambda w: F.length(w) > 2)).alias("terms"))
    return top.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(terms, "query").withColumn("sentences", tx.sentences(F.col("text")))


@query()
def ranked_sentences(spark, sf_dir):
    """The six best sentences of the documents found for every passage."""
    return asm.ranked_sentences(_hits(spark, sf_dir), "terms", "sentences")


@query()
def context_budget(spark, sf_dir):
    """The texts that fit an answer's token budget."""
    return asm.filled_context(_hits(spark, sf_dir).select("query", "rank", "text"))
