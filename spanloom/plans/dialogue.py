"""Queries of conversations: subjects remembered, questions resolved, histories told, tasks planned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversation, planning
from ..sources.tables import table
from .derived import register

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)

#: A sentence of an answer counts as a citation; sentence i stands at so many seconds times i and lasts so many.
EVERY = 12.0
LASTS = 10.0
MOST_CITED = 8


def asked(spark, sf_dir):
    """Turns of users with the answer that follows: conv_id, turn, question, answer, citations (longest sentences first), hits (keywords of the question)."""
    t = table(spark, sf_dir, "conversations")
    answers = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    d = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"], "left")
    said = F.transform(tx.sentences(F.col("answer")), lambda s, i: F.struct((-F.length(s)).alias("k"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(said), 1, MOST_CITED)
    cited = F.transform(best, lambda x: F.struct((x["i"] * EVERY).alias("start"), (x["i"] * EVERY + LASTS).alias("end"), tx.quote(x["s"]).alias("quote")))
    hits = F.array(F.slice(F.array_distinct(tx.keyword_tokens(F.coalesce(F.col("question"), F.lit("")))), 1, conversation.HIT_WORDS))
    return d.withColumn("citations", cited).withColumn("hits", hits)


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_WORDS = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9''-]{{2,}}'), lambda w: NOT list_contains(" + _list(tx.QUESTION_STOP) + ", w))"
_SUBJECT = "list_filter(" + _WORDS + ", lambda w: NOT list_contains(" + _list([*tx.SCAFFOLDING, *conversation.FILLER]) + ", w))"
#: DuckDB has no list_distinct that keeps order.
_ONCE = "list_filter({x}, lambda w, i: list_position({x}, w) = i)"
_KEYWORDS_OF = "list_filter(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z][A-Za-z0-9''-]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + _list(tx.STOP_WORDS) + ", w))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_SQL_ASKED = f"""a AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM a),
c AS (SELECT *, list_transform(list_sort(list_transform(s, lambda x, i: {{'k': -length(x), 'i': i - 1, 's': x}}))[1:{MOST_CITED}],
    lambda x: {{'start': x.i * {EVERY}::DOUBLE, 'end': x.i * {EVERY}::DOUBLE + {LASTS}, 'quote': CASE WHEN length(x.s) <= 220 THEN x.s ELSE regexp_replace(x.s[1:220], '(?s)^(.*) .*$', '\\1') || '...' END}}) AS citations,
    {_KEYWORDS_OF.format(t="coalesce(question, '')")} AS kw FROM b),
e AS (SELECT *, flatten(list_transform(coalesce(citations, [])[1:{conversation.CITED}], lambda x: ({_SUBJECT.format(t="x.quote")})[1:{conversation.CITED_WORDS}])) AS w0, ({_ONCE.format(x="kw")})[1:{conversation.HIT_WORDS}] AS hw FROM c),
g AS (SELECT *, {_ONCE.format(x="w0")} AS w1 FROM e),
h AS (SELECT *, CASE WHEN len(w1) < {conversation.FEW} THEN list_concat(w1, list_filter(hw, lambda w: NOT list_contains(w1, w))) ELSE w1 END AS w2 FROM g),
asked AS (SELECT conv_id, turn, question, answer, citations, w2[1:{conversation.REMEMBERED}] AS keywords FROM h)"""


@query(f"WITH {_SQL_ASKED} SELECT conv_id, turn, len(citations)::INT AS cited, array_to_string(keywords, ' ') AS keywords FROM asked")
def remembered_subjects(spark, sf_dir):
    """What every question with its answer leaves to the next one: subject words of its best citations."""
    d = asked(spark, sf_dir)
    return d.select("conv_id", "turn", F.when(F.col("citations").isNotNull(), F.size("citations")).alias("cited"), F.array_join(conversation.remembered(F.col("citations"), F.col("hits")), " ").alias("keywords"))


def _sql_resolved() -> str:
    places = "CASE lower(word) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in conversation.PLACES.items()) + " END"
    sec = "round_even({x}, 0)::BIGINT::VARCHAR || 's'"
    fresh = "list_filter({x}, lambda w: NOT list_contains(words, w))[1:4]"
    lists = lambda ws: ", ".join(f"'{w}'" for w in ws)
    return f"""WITH {_SQL_ASKED},
p AS (SELECT *, trim(coalesce(question, ''), {_BLANKS}) AS q, lag({{'question': question, 'keywords': keywords, 'citations': citations}}) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM asked),
r AS (SELECT *, {_WORDS.format(t="q")} AS words, regexp_extract(q, '{tx.ORDER_WORDS}', 1) AS word, lower(regexp_extract(q, '{conversation.TIME_WORDS}', 1)) AS tword FROM p),
s AS (SELECT *, len(list_filter(words, lambda w: NOT list_contains({_list(tx.SCAFFOLDING)}, w))) AS n FROM r),
t AS (SELECT *, last IS NOT NULL AND (regexp_matches(q, '{tx.PRONOUNS}') OR (word <> '' AND n <= 1) OR n = 0) AS follows,
    list_sort(list_transform(coalesce(last.citations, []), lambda c, i: {{'start': c.start, 'i': i, 'end': c.end}})) AS ordered, {places} AS place FROM s),
u AS (SELECT *, CASE WHEN follows AND place IS NOT NULL AND place < len(ordered) AND len(ordered) > 0 THEN CASE WHEN place < 0 THEN ordered[len(ordered)] ELSE ordered[place + 1] END END AS named,
    CASE WHEN follows THEN last.citations[1].start END AS focus FROM t),
v AS (SELECT *, CASE WHEN named IS NULL AND focus IS NOT NULL THEN CASE WHEN tword IN ({lists(conversation.AFTER_WORDS)}) THEN 1 WHEN tword IN ({lists(conversation.BEFORE_WORDS)}) THEN -1 END END AS dir,
    {fresh.format(x="coalesce(last.keywords, [])")} AS ck, {fresh.format(x=_WORDS.format(t="coalesce(last.question, '')"))} AS cq FROM u),
w AS (SELECT *, CASE WHEN follows THEN CASE WHEN len(ck) > 0 THEN ck ELSE cq END ELSE [] END AS carried FROM v)
SELECT conv_id, turn, follows, q || CASE WHEN len(carried) > 0 THEN ' ' || array_to_string(carried, ' ') ELSE '' END AS query,
    CASE WHEN named IS NOT NULL THEN greatest(named.start - 5, 0) WHEN dir > 0 THEN focus WHEN dir < 0 THEN greatest(focus - 60, 0) END AS range_start,
    CASE WHEN named IS NOT NULL THEN named.end + 30 WHEN dir > 0 THEN focus + 90 WHEN dir < 0 THEN focus END AS range_end,
    array_to_string(list_filter([CASE WHEN named IS NOT NULL THEN '"' || word || '" resolved to the moment at ' || {sec.format(x="named.start")} END,
        CASE WHEN dir > 0 THEN 'limited to the 90s after ' || {sec.format(x="focus")} WHEN dir < 0 THEN 'limited to the 60s before ' || {sec.format(x="focus")} END,
        CASE WHEN dir IS NOT NULL THEN 'anchored on the previous answer at ' || {sec.format(x="focus")} END,
        CASE WHEN len(carried) > 0 THEN 'carried forward: ' || array_to_string(carried, ', ') END], lambda x: x IS NOT NULL), '; ') AS notes
FROM w"""


@query(_sql_resolved())
def resolved_questions(spark, sf_dir):
    """Every question of the conversations, made to stand on its own by the turn before it."""
    d = conversation.resolve_conversations(asked(spark, sf_dir), "conv_id", "turn", "question", "citations", "hits")
    return d.select("conv_id", "turn", "follows", "query", "range_start", "range_end", F.array_join("notes", "; ").alias("notes"))


@query(f"""WITH a AS (SELECT u.conv_id, u.turn, 'Q: ' || coalesce(u.text, '') || chr(10) || 'A: ' || trim(coalesce(a.text, ''), {_BLANKS})[1:300] AS e
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3),
c AS (SELECT *, sum(length(e)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM b),
d AS (SELECT *, max(CASE WHEN used > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS over FROM c)
SELECT conv_id, md5(coalesce(string_agg(e, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE over = 0), '')) AS digest, count(*) FILTER (WHERE over = 0) AS turns FROM d GROUP BY 1""")
def history_context(spark, sf_dir):
    """The last three turns of every conversation as a context of at most 900 characters."""
    told = conversation.history_budget(asked(spark, sf_dir), "conv_id", "turn", "question", "answer")
    return told.select("conv_id", F.md5("context").alias("digest"), F.size(F.filter(F.split("context", "\n\nQ: |^Q: "), lambda x: x != "")).cast("long").alias("turns"))


_FLAG = {k: f"regexp_matches(q, '(?i){p}')" for k, p in tx.CUES.items()}


def _sql_planned() -> str:
    kinds = "list_filter([CASE WHEN visual OR chart THEN 'visual_lookup' WHEN summary THEN 'summarize' ELSE 'transcript_lookup' END, " + ", ".join(f"CASE WHEN {f} THEN '{k}' END" for k, f in planning.NEEDS.items()) + "], lambda x: x IS NOT NULL)"
    bits = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} THEN '{n}' END" for k, n in planning.INTENTS.items()) + "], lambda x: x IS NOT NULL), '/')"
    bias = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{','.join(f'{c}={w}' for c, w in sorted(b.items()))}'" for k, b in (planning.LOOKUPS | planning.MORE).items()) + " END"
    return f"""WITH a AS (SELECT conv_id, turn, trim(coalesce(text, ''), {_BLANKS}) AS q FROM conversations WHERE role = 'user'),
f AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _FLAG.items())} FROM a),
k AS (SELECT conv_id, turn, {kinds} AS kinds, md5(q || ', treated as a ' || CASE WHEN {bits} = '' THEN 'content' ELSE {bits} END || ' question') AS intent FROM f),
e AS (SELECT *, unnest(kinds) AS kind, generate_subscripts(kinds, 1) AS i FROM k)
SELECT conv_id, turn, 't' || i AS task, kind, CASE WHEN i = 1 THEN '' WHEN kind = 'computation' THEN array_to_string(list_transform(generate_series(1, i - 1), lambda x: 't' || x), ',') ELSE 't1' END AS needs,
    CASE WHEN i = 1 THEN 0 WHEN kind = 'computation' AND i > 2 THEN 2 ELSE 1 END AS level, {bias} AS bias, intent FROM e"""


@query(_sql_planned())
def planned_tasks(spark, sf_dir):
    """The tasks of every question with what each waits for and how it weighs the channels."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("id", F.struct("conv_id", "turn"))
    d = planning.planned(turns, "id", "text")
    bias = F.array_join(F.transform(F.map_entries("bias"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.select("id.conv_id", "id.turn", "task", "kind", F.array_join("needs", ",").alias("needs"), "level", bias.alias("bias"), F.md5("intent").alias("intent"))
