"""Questions of a conversation made to stand on their own: what a turn is about is remembered, and the next one takes it up.

A question that leans on what was said gets the previous turn's subject words, and a stretch of time: around the result that
an order word names, or after or before the moment that the previous answer was about. All of it is column
expressions over a turn and the one before, which a window within buckets of turns finds, so that no conversation is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words of time with the direction they point in, order words with their places, words that frame a sentence.
AFTER_WORDS = ("after", "then", "next", "later", "following", "since")
BEFORE_WORDS = ("before", "earlier", "previously", "preceding", "until")
TIME_WORDS = r"(?i)\b(after|before|then|next|earlier|later|previously|following|preceding|since|until)\b"
PLACES = {"first": 0, "1st": 0, "second": 1, "2nd": 1, "third": 2, "3rd": 2, "fourth": 3, "4th": 3, "fifth": 4, "5th": 4, "last": -1, "final": -1}
FILLER = (
    "let us look looking see seeing watch here now well okay like get got make made take took put want need think know going want lets going "
    "first second third next last also just really very actually basically simply quite bit lot really"
).split()
#: Fixed values, in seconds: how far "after" and "before" look, and what is added around a result.
LOOK_AFTER = 90.0
LOOK_BEFORE = 60.0
LEAD_IN = 5.0
LEAD_OUT = 30.0
#: Words carried over, citations and words of each that a turn remembers, hits and keywords of each where those are few, words remembered at most.
CARRIED = 4
CITED = 3
CITED_WORDS = 6
FEW = 3
HITS = 3
HIT_WORDS = 4
REMEMBERED = 8
#: Turns whose numbers share a bucket are ordered in one task.
BUCKET = 4096
BLANKS = " \t\n\r\x0b\x0c"
CITATIONS = "array<struct<start:double,end:double,quote:string>>"


def subject_words(text: Column) -> Column:
    """The words of a sentence that name what it is about, in order, repeats included."""
    return F.filter(tx.content_words(text), lambda w: ~w.isin(*dict.fromkeys([*tx.SCAFFOLDING, *FILLER])))


def remembered(citations: Column, hit_keywords: Column) -> Column:
    """Subject words of the best citations, each once; where those are few, single-word keywords of the best hits as well. Nulls count as none."""
    quotes = F.slice(F.coalesce(citations, F.array().cast(CITATIONS)), 1, CITED)
    cited = F.array_distinct(F.flatten(F.transform(quotes, lambda c: F.slice(subject_words(F.coalesce(c["quote"], F.lit(""))), 1, CITED_WORDS))))
    hits = F.slice(F.coalesce(hit_keywords, F.array().cast("array<array<string>>")), 1, HITS)
    from_hits = F.filter(F.flatten(F.transform(hits, lambda ks: F.slice(F.coalesce(ks, F.array().cast("array<string>")), 1, HIT_WORDS))), lambda k: k.isNotNull() & ~F.contains(k, F.lit(" ")))
    # bound as the one element of an array, so that it is taken from the quotes once
    both = F.transform(F.array(cited), lambda c: F.when(F.size(c) < FEW, F.array_distinct(F.concat(c, from_hits))).otherwise(c))[0]
    return F.slice(both, 1, REMEMBERED)


def previous_row(df: DataFrame, group: str, order: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``out``: ``value`` of the row before in the group's order (a long, unique in its group), null at its first row.

    Rows are ordered within buckets of the order's numbers; between buckets only each one's last row is carried, so a long group spreads over its buckets.
    """
    d = df.withColumn("__b", F.floor(F.col(order) / bucket)).withColumn("__v", F.struct(value.alias("v")))
    w = W.partitionBy(group, "__b").orderBy(order)
    within = d.withColumn("__p", F.lag("__v").over(w))
    lasts = d.groupBy(group, "__b").agg(F.max_by("__v", order).alias("__last"))
    before = lasts.withColumn("__before", F.lag("__last").over(W.partitionBy(group).orderBy("__b"))).select(F.col(group).alias("__g"), F.col("__b").alias("__c"), "__before")
    joined = within.join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")), "left")
    return joined.withColumn(out, F.coalesce("__p", "__before")["v"]).drop("__b", "__v", "__p", "__before", "__g", "__c")


def seconds(at: Column) -> Column:
    """Whole seconds, halves to the even one, as notes have them."""
    return F.rint(at).cast("long").cast("string")


def resolved(df: DataFrame, question: str, before: str) -> DataFrame:
    """Adds query, follows, range_start, range_end, carried, notes.

    ``before`` is the previous turn as struct<question, keywords array<string>, citations (in order of relevance)>, null at the first turn.
    A question that needs no context, and any first one, stays as it is (trimmed), without range and notes. Null questions count as empty; they need context.
    """
    q = F.btrim(F.coalesce(F.col(question), F.lit("")), F.lit(BLANKS))
    last = F.col(before)
    citations = F.coalesce(last["citations"], F.array().cast(CITATIONS))
    words = tx.content_words(q)
    d = df.withColumn("__q", q).withColumn("follows", last.isNotNull() & tx.leans_on_context(q))
    # the result that an order word names, by time; equal times keep their relevance
    ordered = F.array_sort(F.transform(citations, lambda c, i: F.struct(c["start"].alias("start"), i.alias("i"), c["end"].alias("end"))))
    word = F.regexp_extract("__q", tx.ORDER_WORDS, 1)
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), F.lower(word))
    at = F.when(place < 0, F.size(ordered) + place).otherwise(place)
    d = d.withColumn("__word", word).withColumn("__named", F.when(F.col("follows") & (at >= 0), F.get(ordered, at)))
    named = F.col("__named")
    focus = F.when(F.col("follows"), F.get(citations, F.lit(0))["start"])
    relative = F.lower(F.regexp_extract("__q", TIME_WORDS, 1))
    d = d.withColumn("__time", F.when(named.isNull() & focus.isNotNull(), F.when(relative.isin(*AFTER_WORDS), 1).when(relative.isin(*BEFORE_WORDS), -1))).withColumn("__focus", focus)
    at_focus = F.col("__focus")
    d = d.withColumn("range_start", F.when(named.isNotNull(), F.greatest(named["start"] - LEAD_IN, F.lit(0.0))).when(F.col("__time") > 0, at_focus).when(F.col("__time") < 0, F.greatest(at_focus - LOOK_BEFORE, F.lit(0.0))))
    d = d.withColumn("range_end", F.when(named.isNotNull(), named["end"] + LEAD_OUT).when(F.col("__time") > 0, at_focus + LOOK_AFTER).when(F.col("__time") < 0, at_focus))
    fresh = lambda ws: F.slice(F.filter(ws, lambda w: ~F.array_contains(words, w)), 1, CARRIED)
    none = F.array().cast("array<string>")
    from_keywords, from_question = fresh(F.coalesce(last["keywords"], none)), fresh(tx.content_words(F.coalesce(last["question"], F.lit(""))))
    d = d.withColumn("carried", F.when(F.col("follows"), F.when(F.size(from_keywords) > 0, from_keywords).otherwise(from_question)).otherwise(none))
    has = F.size("carried") > 0
    notes = F.array(
        F.when(named.isNotNull(), F.concat(F.lit('"'), "__word", F.lit('" resolved to the moment at '), seconds(named["start"]), F.lit("s"))),
        F.when(F.col("__time") > 0, F.concat(F.lit(f"limited to the {LOOK_AFTER:.0f}s after "), seconds(at_focus), F.lit("s"))).when(F.col("__time") < 0, F.concat(F.lit(f"limited to the {LOOK_BEFORE:.0f}s before "), seconds(at_focus), F.lit("s"))),
        F.when(F.col("__time").isNotNull(), F.concat(F.lit("anchored on the previous answer at "), seconds(at_focus), F.lit("s"))),
        F.when(has, F.concat(F.lit("carried forward: "), F.array_join("carried", ", "))),
    )
    d = d.withColumn("notes", F.array_compact(notes)).withColumn("query", F.when(has, F.concat("__q", F.lit(" "), F.array_join("carried", " "))).otherwise(F.col("__q")))
    return d.drop("__q", "__word", "__named", "__time", "__focus")


def resolve_conversations(turns: DataFrame, group: str, order: str, question: str, citations: str, hit_keywords: str, bucket: int = BUCKET) -> DataFrame:
    """The turns with keywords (what each remembers) and, by the turn before, query, follows, range_start, range_end, carried, notes."""
    d = turns.withColumn("keywords", remembered(F.col(citations), F.col(hit_keywords)))
    kept = F.struct(F.col(question).alias("question"), "keywords", F.col(citations).cast(CITATIONS).alias("citations"))
    return resolved(previous_row(d, group, order, kept, "__last", bucket), question, "__last").drop("__last")


def history_budget(turns: DataFrame, group: str, order: str, question: str, answer: str, limit: int = 3, budget: int = 900, answer_chars: int = 300) -> DataFrame:
    """group, context: the last ``limit`` turns of each conversation, oldest first, as "Q: ...", "A: ..." with answers trimmed and cut, as long as they fit the budget.

    The first turn that does not fit ends it. Null questions and answers are empty.
    """
    entry = F.concat(F.lit("Q: "), F.coalesce(F.col(question), F.lit("")), F.lit("\nA: "), F.substring(F.btrim(F.coalesce(F.col(answer), F.lit("")), F.lit(BLANKS)), 1, answer_chars))
    rows = turns.select(F.col(group), F.col(order).alias("__o"), entry.alias("__e"))
    # the last of each bucket of turns first, then of all: no more than ``limit`` rows of a bucket meet
    for key in ([group, F.floor(F.col("__o") / BUCKET)], [group]):
        rows = rows.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__o")))).where(F.col("__k") <= limit).drop("__k")
    w = W.partitionBy(group).orderBy("__o").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__used", F.sum(F.length("__e")).over(w)).withColumn("__over", F.max((F.col("__used") > budget).cast("int")).over(w))
    told = F.array_sort(F.collect_list(F.when(F.col("__over") == 0, F.struct("__o", "__e"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(told, lambda x: x["__e"]), "\n\n").alias("context"))
