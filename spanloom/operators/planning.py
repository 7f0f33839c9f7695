"""What a question needs done: its tasks as rows, with what each waits for and how it weighs the channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Weights that a task gives the channels.
LOOKUPS = {
    "visual_lookup": {"image": 1.75, "summary": 1.15, "text": 0.85, "lexical": 0.8},
    "summarize": {"summary": 1.5, "text": 1.1, "image": 0.6, "lexical": 0.7},
    "transcript_lookup": {"text": 1.35, "lexical": 1.25, "summary": 0.95, "image": 0.55},
}
MORE = {
    "speaker_attribution": {"text": 1.3, "lexical": 1.2, "image": 0.4},
    "temporal_locate": {"image": 1.2, "text": 1.0},
    "chart_extraction": {"image": 1.8},
    "computation": {},
    "compare": {"summary": 1.2},
}
NEEDS = {"speaker_attribution": "attribution", "temporal_locate": "temporal", "chart_extraction": "chart", "computation": "compute", "compare": "compare"}
INTENTS = {"visual": "visual", "temporal": "temporal", "compute": "numeric", "attribution": "attribution", "summary": "summary"}


def weights(bias: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(bias.items()) for x in (k, v)]) if bias else F.create_map().cast("map<string,double>")


def planned(df: DataFrame, row_id: str, question: str) -> DataFrame:
    """id, task (t1, t2, ...), kind, needs (tasks that come before), level (supersteps before it), bias, intent: a row per question and task.

    Every question has one lookup, led by what it asks for: something seen, an overview, or words. Whatever else its cues ask for waits for the lookup; a
    computation waits for all tasks before it. One narrow pass. Null questions count as empty.
    """
    q = F.btrim(F.coalesce(F.col(question), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    flags = tx.intent_flags(F.col("__q"))
    d = df.select(F.col(row_id), q.alias("__q")).select(row_id, "__q", *[c.alias(f"__{k}") for k, c in flags.items()])
    on = lambda k: F.col(f"__{k}")
    first = F.when(on("visual") | on("chart"), "visual_lookup").when(on("summary"), "summarize").otherwise("transcript_lookup")
    kinds = F.array_compact(F.array(first, *[F.when(on(flag), kind) for kind, flag in NEEDS.items()]))
    bits = F.array_join(F.array_compact(F.array(*[F.when(on(k), name) for k, name in INTENTS.items()])), "/")
    intent = F.concat("__q", F.lit(", treated as a "), F.when(bits == "", "content").otherwise(bits), F.lit(" question"))
    each = d.select(row_id, intent.alias("intent"), F.posexplode(kinds).alias("__i", "kind"))
    name = lambda i: F.concat(F.lit("t"), (i + 1).cast("string"))
    before = F.when(F.col("__i") == 0, F.array().cast("array<string>")).when(F.col("kind") == "computation", F.transform(F.sequence(F.lit(0), F.greatest(F.col("__i") - 1, F.lit(0))), name)).otherwise(F.array(F.lit("t1")))
    # a computation is one superstep behind the tasks that only wait for the lookup, if there are any
    level = F.when(F.col("__i") == 0, 0).when((F.col("kind") == "computation") & (F.col("__i") > 1), 2).otherwise(1)
    table = LOOKUPS | MORE
    bias = F.coalesce(*[F.when(F.col("kind") == k, weights(v)) for k, v in table.items()])
    return each.select(row_id, name(F.col("__i")).alias("task"), "kind", before.alias("needs"), level.alias("level"), bias.alias("bias"), "intent")
