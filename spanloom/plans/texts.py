"""Queries of text analysis over documents as chunks of a source, and over conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import terms
from ..sources.tables import table
from .derived import SQL_CHUNKS, chunks, register

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)

_STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(tx.STOP_WORDS)) + "]"
_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]+'), lambda w: lower(w)), lambda w: len(w) >= LEAST AND NOT list_contains({_STOP}, w))"
_SCORES = f"""WITH {SQL_CHUNKS}, t AS (SELECT video_id, doc_id, {_WORDS.replace('LEAST', '3')} AS t FROM chunks),
u AS (SELECT video_id, doc_id, 2 * len(t) - 1 AS total, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t WHERE len(t) > 0),
c AS (SELECT video_id, doc_id, total, term, count(*) AS tf FROM u GROUP BY ALL), n AS (SELECT video_id, count(*) AS n FROM chunks GROUP BY 1), f AS (SELECT video_id, term, count(*) AS df FROM c GROUP BY 1, 2),
s AS (SELECT video_id, doc_id, term, round((1 + ln(tf)) / ln(2.0::DOUBLE + total) * ln((n + 1)::DOUBLE / (df + 0.5::DOUBLE)) * CASE WHEN contains(term, ' ') THEN 1.4::DOUBLE ELSE 1 END, 6) AS score
  FROM c JOIN n USING (video_id) JOIN f USING (video_id, term) WHERE (tf >= 2 OR NOT contains(term, ' ')) AND (df < n OR n <= 1)),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term))::INT AS rank FROM s QUALIFY rank <= 12)"""


def _keywords(spark, sf_dir):
    return terms.ranked_terms(terms.keyword_scores(chunks(spark, sf_dir), "video_id", "doc_id", "text"), ["doc_id"])


@query(_SCORES + " SELECT * FROM k")
def keywords_tfidf_scores(spark, sf_dir):
    """The twelve best-scored terms of every chunk."""
    return _keywords(spark, sf_dir).where("rank <= 12")


@query()
def keywords_greedy(spark, sf_dir):
    """The six keywords of every chunk after substring suppression."""
    return terms.keywords(terms.keyword_scores(chunks(spark, sf_dir), "video_id", "doc_id", "text"), "video_id", "doc_id")


_TOPICS = f""", w AS (SELECT video_id, doc_id, unnest({_WORDS.replace('LEAST', '4')}) AS term FROM chunks), h AS (SELECT video_id, term, count(*) AS hits FROM k WHERE rank <= 6 AND NOT contains(term, ' ') GROUP BY 1, 2),
p AS (SELECT video_id, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1, 2),
o AS (SELECT p.video_id, term, round((1 + ln(tf)) * sqrt(df::DOUBLE / n) * (1 + 0.35::DOUBLE * least(coalesce(hits, 0), 3)), 6) AS score FROM p JOIN n USING (video_id) LEFT JOIN h USING (video_id, term)
  JOIN (SELECT video_id, max(tf) AS most FROM p GROUP BY 1) USING (video_id) WHERE tf >= 2 OR most < 2)"""


@query(_SCORES + _TOPICS + " SELECT video_id, term, score FROM o QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, term) <= 20")
def topics_scores(spark, sf_dir):
    """The twenty best topics of every source."""
    scored = terms.topic_scores(chunks(spark, sf_dir), "video_id", "doc_id", "text")
    return terms.ranked_terms(scored, ["video_id"]).where("rank <= 20").drop("rank")


@query()
def topics_greedy(spark, sf_dir):
    """Eight topics of every source after substring suppression."""
    return terms.group_keywords(terms.topic_scores(chunks(spark, sf_dir), "video_id", "doc_id", "text"), "video_id", 8)


@query(
    _SCORES
    + """, q AS (SELECT * FROM k WHERE rank <= 6), m AS (SELECT video_id, term, count(*) AS c FROM q GROUP BY 1, 2),
z AS (SELECT q.video_id, q.doc_id, round(sum(c)::DOUBLE / (1 + 0.15::DOUBLE * count(*)), 6) AS score FROM q JOIN m USING (video_id, term) GROUP BY 1, 2)
SELECT video_id, doc_id, score, (row_number() OVER (PARTITION BY video_id ORDER BY score DESC, doc_id))::INT AS rank FROM z QUALIFY rank <= 3"""
)
def extractive_summary_scores(spark, sf_dir):
    """The three chunks of every source that cover most of its keywords."""
    scored = terms.summary_scores(_keywords(spark, sf_dir).where("rank <= 6"), "video_id", "doc_id")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 3")


@query("""SELECT doc_id, i AS idx, md5(s[i]) AS digest FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents))""")
def sentences_split(spark, sf_dir):
    """The sentences of every document."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "s"))
    return s.select("doc_id", (F.col("i") + 1).cast("long").alias("idx"), F.md5("s").alias("digest"))


@query(f"""WITH {SQL_CHUNKS} SELECT doc_id, md5(concat_ws(' ', right(lag(text) OVER w, 220), text, left(lead(text) OVER w, 220))) AS digest FROM chunks WINDOW w AS (PARTITION BY video_id ORDER BY idx)""")
def context_widening(spark, sf_dir):
    """Every chunk with the end of the one before and the beginning of the one after."""
    w = W.partitionBy("video_id").orderBy("idx")
    before, after = F.right(F.lag("text").over(w), F.lit(220)), F.left(F.lead("text").over(w), F.lit(220))
    return chunks(spark, sf_dir).select("doc_id", F.md5(F.concat_ws(" ", before, "text", after)).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b(sk-or-v1-|sk-|gsk_|hf_|ghp_|xox[baprs]-)[A-Za-z0-9_\-]{8,}', '[redacted]', 'g'), '(?i)\b(api[_-]?key|authorization|bearer|token|password|secret)\b\s*[:=]\s*\S+', '[redacted]', 'g')) AS digest FROM documents""")
def redact_secrets(spark, sf_dir):
    """Every whole document without credentials."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redact(F.col("text"))).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(c, '^[=+\-@\t\r]') THEN '''' || c ELSE c END AS cell FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || url AS c FROM pages)""")
def csv_guard(spark, sf_dir):
    """Cells that would run as formulas, guarded."""
    sign = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", tx.guard_formula(F.concat(sign, "url")).alias("cell"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 80) AS s FROM pages)""")
def slugify(spark, sf_dir):
    """File names from addresses."""
    return table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("""WITH t AS (SELECT event_id, value * 37 AS t FROM events), c AS (SELECT *, floor(t)::BIGINT AS w, floor(t * 1000 + 0.5)::BIGINT AS ms FROM t)
SELECT event_id, CASE WHEN w >= 3600 THEN printf('%d:%02d:%02d.%d', w // 3600, w % 3600 // 60, w % 60, floor((t - w) * 10)::BIGINT) ELSE printf('%d:%02d.%d', w % 3600 // 60, w % 60, floor((t - w) * 10)::BIGINT) END AS clock,
printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS cue, ms / 1000.0::DOUBLE AS back FROM c""")
def format_timestamps(spark, sf_dir):
    """Clock and cue forms of seconds, and the cue read back."""
    t = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 37).alias("t"))
    return t.select("event_id", tx.clock(F.col("t")).alias("clock"), tx.cue_time(F.col("t")).alias("cue")).withColumn("back", tx.parse_time(F.col("cue")))


_QUESTIONS = (
    "What is shown on the slide?", "When did they mention revenue?", "How many users in total?", "Who said that?", "Give me an overview", "Compare A versus B", "Plot the figures in the chart",
    "what happened after that", "why?", "and then?", "What about the Kubernetes rollout", "the second one", "tell me more about it", "latency budget numbers", "first", "how long is the demo",
)


def _questions(spark, sf_dir):
    """Fixed questions and every turn of the users."""
    fixed = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(_QUESTIONS)], "id long, question string")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return fixed.unionByName(turns)


_SQL_QUESTIONS = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{q}')" for i, q in enumerate(_QUESTIONS)) + ") v(id, question) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"
_FLAGS = {k: f"regexp_matches(question, '(?i){p}')" for k, p in tx.CUES.items()}


@query(f"WITH {_SQL_QUESTIONS}, f AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _FLAGS.items())} FROM q) SELECT *, CASE WHEN compute THEN 'numeric' WHEN chart THEN 'table' WHEN summary THEN 'narrative' ELSE 'timestamped' END AS style FROM f")
def intent_flags(spark, sf_dir):
    """What every question is after, and the form of its answer."""
    flags = tx.intent_flags(F.col("question"))
    return _questions(spark, sf_dir).select("id", *[c.alias(k) for k, c in flags.items()], tx.answer_style(flags).alias("style"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH {_SQL_QUESTIONS}, s AS (SELECT id, question, len(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9''-]{{2,}}'), lambda w: NOT list_contains({_LIST(tx.QUESTION_STOP)}, w) AND NOT list_contains({_LIST(tx.SCAFFOLDING)}, w))) AS n FROM q)
SELECT id, regexp_matches(question, '{tx.PRONOUNS}') OR (regexp_matches(question, '{tx.ORDER_WORDS}') AND n <= 1) OR n = 0 AS follows FROM s""")
def followup_class(spark, sf_dir):
    """Whether a question leans on what came before."""
    return _questions(spark, sf_dir).select("id", tx.leans_on_context(F.col("question")).alias("follows"))


@query()
def fuzzy_commands(spark, sf_dir):
    """The twelve source names that match each of some typed needles best."""
    names = table(spark, sf_dir, "documents").select(F.concat_ws(" ", "source", "lang").alias("name")).distinct()
    needles = spark.createDataFrame([("src1",), ("s en",), ("1 d",), ("xyz",), ("",)], "needle string")
    scored = names.join(F.broadcast(needles), how="cross").withColumn("score", tx.subsequence_score(F.col("needle"), F.col("name"))).where("score >= 0")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("needle").orderBy(F.desc("score"), "name"))).where("rank <= 12")
