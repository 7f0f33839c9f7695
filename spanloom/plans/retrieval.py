"""Queries of vector search, fusion and the hybrid search built from them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bm25, cells, fusion, vectors
from ..operators import sequential as seq
from ..sources.tables import materialized, table
from .derived import SQL_SPANS, register, spans
from .lexical import bm25_sql

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)
CANDIDATES = 48
#: Every so many vectors one is a query against all.
EVERY = 20


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _knn(spark, sf_dir, k, where=None):
    v = _vectors(spark, sf_dir)
    q = v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query"), "vec")
    return vectors.knn(q, v if where is None else v.where(where), k)


def _knn_sql(k, where="true"):
    return f"""k AS (SELECT query, id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS id, b.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND b.{where if where != 'true' else 'vec_id IS NOT NULL'})) WHERE rank <= {k})"""


@query(f"WITH {_knn_sql(10)} SELECT * FROM k")
def knn_exact(spark, sf_dir):
    """Ten nearest vectors of every twentieth one, exactly."""
    return _knn(spark, sf_dir, 10)


@query(f"WITH {_knn_sql(10, 'label < 3')} SELECT * FROM k")
def knn_filtered(spark, sf_dir):
    """The same among three labels; the filter comes first, so ten are found."""
    return _knn(spark, sf_dir, 10, F.col("label") < 3)


@query()
def knn_index(spark, sf_dir):
    """The same ten from an index of cells that holds every vector; approximate, so it has no SQL and is held against knn_exact."""
    v = _vectors(spark, sf_dir)
    made = cells.fit(v)
    return cells.search(v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query"), "vec"), materialized(cells.index(v, made)), made, 10)


@query(f"WITH {_knn_sql(CANDIDATES)} SELECT query, label, max(score) AS score, arg_min(id, (-score, id)) AS best_child FROM k JOIN embeddings e ON e.vec_id = k.id GROUP BY 1, 2")
def rollup_maxpool(spark, sf_dir):
    """The candidates' labels as parents: the best child of each."""
    hits = _knn(spark, sf_dir, CANDIDATES).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    return vectors.rollup(hits, "query", "label", "id", "score")


def _lists(spark, sf_dir):
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    # scored once; each document stands in the lists that it belongs to
    lexical = bm25.top_lists(docs, passages, CANDIDATES, {"lexical": F.lit(True), "text": F.col("lang") == "en"}).select("query", F.col("list").alias("channel"), "doc", "rank", "score")
    near = _knn(spark, sf_dir, CANDIDATES).select((F.col("query") / EVERY).cast("long").alias("query"), F.lit("image").alias("channel"), F.col("id").alias("doc"), "rank", "score")
    return lexical.unionByName(near)


_RANK = f"SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= {CANDIDATES}"
_LISTS = f"""WITH a AS ({bm25_sql(tail=_RANK)}), b AS ({bm25_sql(where="p.lang = 'en'", tail=_RANK)}), {_knn_sql(CANDIDATES)},
lists AS (SELECT query, 'lexical' AS channel, doc, rank, score FROM a UNION ALL SELECT query, 'text', doc, rank, score FROM b UNION ALL SELECT query // {EVERY}, 'image', id, rank, score FROM k)"""
_WEIGHTS = (
    _LISTS
    + f""", t AS (SELECT *, max(score) OVER (PARTITION BY query, channel) AS top FROM lists),
g AS (SELECT query, channel, count(*) AS n, max(score) AS top, median(score) AS med, sum(exp((score - top) / {fusion.TEMPERATURE})) AS z, sum(exp((score - top) / {fusion.TEMPERATURE}) * (score - top) / {fusion.TEMPERATURE}) AS ex FROM t GROUP BY 1, 2),
w AS (SELECT query, channel, greatest({fusion.FLOOR}, CASE channel {' '.join(f"WHEN '{k}' THEN {v}" for k, v in fusion.PRIORS.items())} ELSE 1.0 END::DOUBLE
  * (1 - CASE WHEN n <= 1 THEN 0 ELSE least(1, greatest(0, (ln(z) - ex / z) / ln(n))) END) * (1 + (top - med) / (abs(top) + 1e-12))) AS raw FROM g),
weights AS (SELECT query, channel, round(raw * count(*) OVER (PARTITION BY query) / sum(raw) OVER (PARTITION BY query), 6) AS weight FROM w)"""
)


@query(_WEIGHTS + " SELECT * FROM weights")
def adaptive_weights(spark, sf_dir):
    """How much each channel of each query counts, by how clear its scores are."""
    return fusion.adaptive_weights(_lists(spark, sf_dir))


def _fused(spark, sf_dir):
    return fusion.fused_order(fusion.fuse(fusion.weighted(_lists(spark, sf_dir))))


@query(
    _WEIGHTS
    + f""", f AS (SELECT query, doc, round(sum(weight / ({fusion.RRF_K} + rank)), 6) AS score, min(rank)::INT AS best_rank, string_agg(channel, ',' ORDER BY channel) AS channels FROM lists JOIN weights USING (query, channel) GROUP BY 1, 2)
SELECT query, doc, score, best_rank, channels, (row_number() OVER (PARTITION BY query ORDER BY score DESC, best_rank, doc))::INT AS place FROM f QUALIFY place <= 24"""
)
def rrf_fused(spark, sf_dir):
    """The first 24 of the fused channels of each query."""
    return _fused(spark, sf_dir).where("place <= 24").select("query", "doc", "score", "best_rank", F.array_join("channels", ",").alias("channels"), "place")


_PARTS = "SELECT item_id * 1000 + i AS query, s[i] AS text FROM (SELECT item_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark))"


@query(
    f"""WITH a AS ({bm25_sql(tail="SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 10", queries=_PARTS)})
SELECT query // 1000 AS query, doc, max(score) AS best, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS lists FROM a GROUP BY 1, 2"""
)
def multi_query_fusion(spark, sf_dir):
    """Each sentence of a passage as a query of its own; their lists fused, and each document's best score."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "text"))
    parts = parts.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("item_id"), "text")
    top = bm25.top(table(spark, sf_dir, "documents"), parts)
    top = top.withColumn("query", F.floor(F.col("query") / 1000))
    return top.groupBy("query", "doc").agg(F.max("score").alias("best"), F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.count(F.lit(1)).alias("lists"))


@query(f"""WITH {SQL_SPANS}, p AS (SELECT id, kind, ("start" + "end") / 2 AS m, value AS s FROM spans)
SELECT a.kind, a.id, round(a.s + 0.18 * coalesce(sum(b.s * exp(-abs(a.m - b.m) / 45.0::DOUBLE)), 0), 5) AS score FROM p a LEFT JOIN p b ON a.kind = b.kind AND a.id <> b.id AND abs(a.m - b.m) <= 180 GROUP BY a.kind, a.id, a.s""")
def temporal_diffusion(spark, sf_dir):
    """Scores of events raised by their neighbours in time."""
    s = spans(spark, sf_dir).withColumn("m", (F.col("start") + F.col("end")) / 2)
    return fusion.diffuse(s, "kind", "id", "m", "value").withColumn("score", F.round("score", 5))


@query(
    f"""WITH a AS ({bm25_sql(tail="SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 48")}),
g AS (SELECT doc_id AS doc, max(quality)::DOUBLE AS gain FROM labels GROUP BY 1), i AS (SELECT sum(gain / log2(k + 1)) AS ideal FROM (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS k FROM g WHERE gain > 0 QUALIFY k <= 10)),
h AS (SELECT query, rank, coalesce(gain, 0) AS gain FROM a LEFT JOIN g USING (doc))
SELECT query, round(coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 10), 0) / any_value(ideal), 6) AS ndcg, round((count(*) FILTER (rank <= 10 AND gain > 0))::DOUBLE / (SELECT count(*) FROM g WHERE gain > 0), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (gain > 0), 0), 6) AS mrr FROM h, i GROUP BY 1"""
)
def ndcg_recall_mrr(spark, sf_dir):
    """Quality of the lexical lists, with the labels as gains."""
    lists = bm25.top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), CANDIDATES)
    return fusion.metrics(lists, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("gain")))


@query()
def mmr_select(spark, sf_dir):
    """Eight of the 24 nearest vectors of each query, diversified."""
    hits = _knn(spark, sf_dir, 24).join(_vectors(spark, sf_dir).select("id", "vec"), "id")
    return seq.mmr_select(hits, "query", "id", "score", "vec", 8)


@query()
def hybrid_search(spark, sf_dir):
    """Channels fused, smoothed over neighbouring chunks of a source, and the best eight diversified."""
    from .derived import chunks

    spans_of = chunks(spark, sf_dir).select(F.col("doc_id").alias("doc"), "video_id", ((F.col("start") + F.col("end")) / 2).alias("m"))
    shortlist = _fused(spark, sf_dir).where("place <= 24").join(spans_of, "doc")
    keyed = shortlist.withColumn("g", F.struct("query", "video_id"))
    smooth = fusion.diffuse(keyed, "g", "doc", "m", "score").select(F.col("g.query").alias("query"), F.col("id").alias("doc"), F.round("score", 6).alias("score"))
    vec = _vectors(spark, sf_dir).select(F.col("id").alias("doc"), "vec")
    return seq.mmr_select(smooth.join(vec, "doc", "left"), "query", "doc", "score", "vec", 8)
