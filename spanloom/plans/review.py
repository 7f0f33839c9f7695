"""Queries that judge what was retrieved: coverage and questions asked again, citations at the sentences that matched, evidence by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, critic, evidence
from ..sources.tables import table
from .derived import SQL_CHUNKS, chunks, register
from .lexical import bm25_sql

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_MEANING = "list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9][a-z0-9''-]{{2,}}'), lambda w: NOT list_contains(" + _list(critic.STOP) + ", w))"
_KEYS = "list_filter(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z][A-Za-z0-9''-]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + _list(tx.STOP_WORDS) + ", w))"
_ONCE = "list_filter({x}, lambda w, i: list_position({x}, w) = i)"
_TOP5 = f"SELECT query, doc, score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= {critic.HITS}"


def _sql_rounds() -> str:
    parts = []
    for i in (1, 2):
        if i == 1:
            parts.append("o1 AS (SELECT item_id AS query, text, [coalesce(text, '')] AS asked FROM benchmark)")
            parts.append(f"n1 AS ({bm25_sql(tail=_TOP5)})")
            parts.append("b1 AS (SELECT * FROM n1)")
        else:
            parts.append("o2 AS (SELECT o1.query, o1.text, g1.asked FROM o1 JOIN g1 USING (query))")
            parts.append("e2 AS (SELECT {'q': query, 'i': i} AS query, asked[i] AS text FROM (SELECT *, unnest(generate_series(1, len(asked))) AS i FROM o2))")
            parts.append(f"n2 AS ({bm25_sql(tail=_TOP5, queries='SELECT query, text FROM e2')})")
            parts.append("b2 AS (SELECT query, doc, max(score) AS score FROM (SELECT query, doc, score FROM h1 UNION ALL SELECT query.q, doc, score FROM n2) GROUP BY 1, 2)")
        parts.append(f"h{i} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b{i} QUALIFY rank <= {critic.HITS})")
        parts.append(f"x{i} AS (SELECT doc_id AS doc, list_distinct({_MEANING.format(t='text')}) AS terms, {_KEYS.format(t='text')} AS kw FROM documents WHERE doc_id IN (SELECT doc FROM h{i}))")
        parts.append(f"y{i} AS (SELECT doc, w, count(*) AS n FROM (SELECT doc, unnest(kw) AS w FROM x{i}) GROUP BY 1, 2)")
        parts.append(f"k{i} AS (SELECT doc, list(w ORDER BY n DESC, w)[1:{critic.KEYWORDS}] AS keywords FROM y{i} GROUP BY 1)")
        parts.append(f"q{i} AS (SELECT query, text, asked, {_ONCE.format(x=_MEANING.format(t='text'))} AS wanted FROM o{i})")
        parts.append(
            f"p{i} AS (SELECT q.query, list_distinct(flatten(list(list_filter(q.wanted, lambda w: list_contains(x.terms, w))))) AS got, list(coalesce(k.keywords, []) ORDER BY rank) FILTER (WHERE rank <= {critic.ANCHOR_HITS}) AS kl,"
            f" list_sort(list_distinct(flatten(list(list_sort(x.terms)[1:{critic.FROM_FOUND}]))))[1:{critic.FROM_FOUND}] AS seen, max(score) FILTER (WHERE rank = 1) AS top, avg(score) FILTER (WHERE rank BETWEEN 2 AND {1 + critic.RIVALS}) AS rest"
            f" FROM h{i} h JOIN q{i} q USING (query) JOIN x{i} x USING (doc) LEFT JOIN k{i} k USING (doc) GROUP BY 1)"
        )
        parts.append(
            f"j{i} AS (SELECT q.*, got IS NOT NULL AS hit, round(CASE WHEN got IS NULL THEN 0 WHEN len(wanted) = 0 THEN 1 ELSE len(got)::DOUBLE / len(wanted) END, 6) AS coverage,"
            f" round(CASE WHEN top > 1e-9 AND rest IS NOT NULL THEN (top - rest) / top ELSE 0 END, 6) AS margin, list_sort(list_filter(wanted, lambda w: NOT list_contains(coalesce(got, []), w))) AS missing,"
            f" flatten(coalesce(kl, [])) AS kf, coalesce(seen, []) AS seen FROM q{i} q LEFT JOIN p{i} USING (query))"
        )
        parts.append(f"v{i} AS (SELECT *, ({_ONCE.format(x='kf')})[1:{critic.ANCHORS}] AS anchors, hit AND coverage >= {critic.ENOUGH} AND margin >= {critic.CLEAR} AS accepted FROM j{i})")
    said = lambda x: f"array_to_string({x}, ' ')"
    shortest = "list_transform(list_sort(list_transform(mw, lambda w, i: {'n': length(w), 'i': i, 'w': w}))[1:greatest(2, len(mw) - 2)], lambda s: s.w)"
    broad = f"CASE WHEN len(mw) > 2 THEN {said(shortest)} ELSE text END"
    cand = (
        f"CASE WHEN hit THEN [CASE WHEN len(missing) > 0 AND len(anchors) > 0 THEN {said(f'list_concat(missing[1:{critic.WITH_ANCHORS}], anchors[1:{critic.WITH_ANCHORS}])')} END,"
        f" CASE WHEN len(missing) > 0 THEN {said(f'missing[1:{critic.ALONE}]')} END, CASE WHEN len(missing) = 0 THEN {said('seen')} END] ELSE [{broad}] END"
    )
    after = [
        f"c1 AS (SELECT query, text, {cand} AS c0 FROM (SELECT *, {_MEANING.format(t='text')} AS mw FROM v1 WHERE NOT accepted))",
        f"d1 AS (SELECT query, {_ONCE.format(x='c0')} AS c1, text FROM c1)",
        f"g1 AS (SELECT query, list_filter(c1, lambda t: t IS NOT NULL AND trim(t) <> '' AND lower(t) <> lower(coalesce(text, '')))[1:{critic.ASKED_AGAIN}] AS asked FROM d1 WHERE len(asked) > 0)",
    ]
    k = next(i for i, p in enumerate(parts) if p.startswith("o2 "))
    parts[k:k] = after
    line = "SELECT query, {i} AS round, array_to_string(asked, ' | ') AS asked, coverage, margin, accepted FROM v{i}"
    return f"WITH {', '.join(parts)} {line.format(i=1)} UNION ALL {line.format(i=2)}"


@query(_sql_rounds())
def critic_rounds(spark, sf_dir):
    """Two rounds of retrieval for every passage: how well the hits cover it, and what is asked again where they do not."""
    log, _ = critic.reviewed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return log.select("query", "round", F.array_join("asked", " | ").alias("asked"), "coverage", "margin", "accepted")


def _hits(spark, sf_dir, k=8):
    """The best documents for every passage as chunks of their source: query, doc, rank, score, terms, sentences, video, start, end, text."""
    docs, passages = chunks(spark, sf_dir), table(spark, sf_dir, "benchmark")
    top = bm25.top(table(spark, sf_dir, "documents"), passages, k)
    terms = passages.select(F.col("item_id").alias("query"), F.array_distinct(F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, "[.,!?;:]+$", "")), lambda w: F.length(w) > 2)).alias("terms"))
    d = docs.select(F.col("doc_id").alias("doc"), F.col("video_id").alias("video"), "start", "end", "text")
    return top.join(d, "doc").join(terms, "query").withColumn("sentences", tx.sentences(F.col("text")))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SQL_HITS = f"""{SQL_CHUNKS}, top AS ({bm25_sql(tail="SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 8")}),
terms AS (SELECT item_id AS query, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[.,!?;:]+$', '')), lambda w: length(w) > 2) AS terms FROM benchmark),
hits AS (SELECT query, doc, rank, score, terms, {_SENTENCES} AS sentences, video_id AS video, "start", "end", text FROM top JOIN (SELECT doc_id AS doc, video_id, "start", "end", text FROM chunks) USING (doc) JOIN terms USING (query))"""
_SPLIT = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_SQL_RANKED = f"""s AS (SELECT * FROM (SELECT query, doc, rank, terms, "start", "end", sentences, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS ix FROM hits)),
w AS (SELECT *, list_distinct(list_transform({_SPLIT.format(x='lower(sentence)')}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:]+', ''), '[.,!?;:]+$', ''))) AS words FROM s WHERE len({_SPLIT.format(x='sentence')}) >= 3),
z AS (SELECT *, round(1 / (1 + 0.4::DOUBLE * (rank - 1)) * (0.25::DOUBLE + len(list_filter(words, lambda w: list_contains(terms, w))) / sqrt(len(words))), 6) AS sc, left(trim(regexp_replace(lower(sentence), '\\s+', ' ', 'g'), ' '), 90) AS key FROM w),
u AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY sc DESC, rank, ix) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sc DESC, rank, ix) AS place FROM u QUALIFY place <= {evidence.CITED})"""


@query(f"""WITH {_SQL_HITS}, {_SQL_RANKED},
x AS (SELECT *, list_position(sentences, sentence) AS p, greatest(list_sum(list_transform(sentences, lambda v: length(v))), 1) AS total FROM ranked),
y AS (SELECT *, coalesce(list_sum(list_transform(sentences[1:p - 1], lambda v: length(v))), 0) AS before, list_sum(list_transform(sentences[1:p], lambda v: length(v))) AS upto FROM x)
SELECT query, place, doc, round("start" + before::DOUBLE / total * ("end" - "start"), 3) AS "start", round("start" + upto::DOUBLE / total * ("end" - "start"), 3) AS "end", md5(left(sentence, {evidence.QUOTE})) AS quote, sc AS relevance, 'sentence' AS kind FROM y
UNION ALL SELECT query, rank, doc, "start", "end", md5(left(coalesce(text, ''), {evidence.QUOTE})), score, 'hit' FROM hits WHERE rank <= {evidence.CITED} AND query NOT IN (SELECT query FROM ranked)""")
def citations_refined(spark, sf_dir):
    """What an answer to every passage cites: its best sentences at their own times, or whole hits where there are none."""
    return evidence.refined_citations(_hits(spark, sf_dir)).withColumn("quote", F.md5("quote"))


@query(f"""WITH {_SQL_HITS}, b AS (SELECT query, arg_min(video, rank) AS best FROM hits WHERE text <> '' GROUP BY 1)
SELECT query, count(*) AS parts, md5(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), ' ' ORDER BY "start", doc)) AS digest FROM hits JOIN b USING (query) WHERE text <> '' AND video IS NOT DISTINCT FROM best GROUP BY 1""")
def spoken_evidence(spark, sf_dir):
    """The passage that numbers are read from: of each question's hits those in the recording of the best one, in the order of time."""
    hits = _hits(spark, sf_dir)
    parts = hits.join(hits.where("rank = 1").select("query", F.col("video").alias("best")), "query").where("video = best").groupBy("query").agg(F.count(F.lit(1)).alias("parts"))
    return evidence.spoken_passages(hits).select("query", F.md5("passage").alias("digest")).join(parts, "query")


@query()
def evidence_numbers(spark, sf_dir):
    """Numbers for every passage: prices of parts as if read from frames for every third one, else those of the spoken passage."""
    hits = _hits(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("query"), F.col("p_partkey").cast("int").alias("place"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("value"), F.lit("$").alias("unit"))
    return evidence.collected(parts.where("query % 3 = 0"), hits)
