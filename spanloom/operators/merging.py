"""Merging of maps, lists and states, titles from keywords, marks in answers, and recovery of broken JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_maps(base: Column, over: Column) -> Column:
    """All keys of both maps; where both have one, the second map's value stands. A null map counts as empty only beside another."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.coalesce(F.map_concat(kept, over), over, base)


def folded_state(updates: DataFrame, group: str, order: str, appended: str, merged: str, replaced: str) -> DataFrame:
    """Per group: lists appended in order, maps merged with later keys winning, the last value that is not null."""
    found = F.collect_list(F.struct(F.col(order).alias("o"), F.col(appended).alias("a"), F.col(merged).alias("m")))
    rows = F.array_sort(found, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))  # maps have no order of their own
    g = updates.groupBy(group).agg(rows.alias("__rows"), F.max_by(replaced, F.when(F.col(replaced).isNotNull(), F.col(order))).alias(replaced))
    lists = F.flatten(F.transform(F.filter("__rows", lambda x: x["a"].isNotNull()), lambda x: x["a"]))
    empty = F.create_map().cast(updates.schema[merged].dataType)
    maps = F.aggregate(F.filter("__rows", lambda x: x["m"].isNotNull()), empty, lambda acc, x: merged_maps(acc, x["m"]))
    return g.select(group, lists.alias(appended), maps.alias(merged), replaced)


def distinct_ignoring_case(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of every text, compared trimmed and in lower case; null texts go."""
    w = W.partitionBy(F.lower(F.trim(F.col(text)))).orderBy(order)
    return df.where(F.col(text).isNotNull()).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def union_of_absent(base: DataFrame, more: DataFrame, kind: str) -> DataFrame:
    """The base, and rows of the other table whose kind the base does not have."""
    return base.unionByName(more.join(base.select(kind).distinct(), kind, "left_anti"))


def mean_per_key(df: DataFrame, biases: str) -> DataFrame:
    """key, mean over all maps that have it."""
    return df.select(F.explode(biases).alias("key", "v")).groupBy("key").agg(F.round(F.avg("v"), 4).alias("mean"))


def titles(words: DataFrame, group: str, word: str, text: DataFrame, text_col: str) -> DataFrame:
    """group, keywords (six most frequent, ties by word), title: three of them, else the text's first eight words, else a fixed phrase."""
    counts = words.groupBy(group, word).agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(word).alias("w")))), 1, 6)
    found = counts.groupBy(group).agg(F.transform(best, lambda x: x["w"]).alias("keywords"))
    head = F.array_join(F.slice(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != ""), 1, 8), " ")
    title = F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), ", ")).when(head != "", head).otherwise("Untitled section")
    out = text.select(group, text_col).join(found, group, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return out.select(group, "keywords", title.alias("title"))


def time_marks(answer: Column) -> Column:
    """Seconds of every [mm:ss] or [h:mm:ss] mark in an answer, in order."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[((?:\d+:)?\d{1,2}:\d{2})\]"), F.lit(1))
    return F.transform(marks, lambda m: F.aggregate(F.transform(F.split(m, ":"), lambda p: p.cast("long")), F.lit(0).cast("long"), lambda s, p: s * 60 + p))


def best_frames(frames: DataFrame, query: str, frame: str, rank: str, quality: str, chart: Column, limit: int = 4) -> DataFrame:
    """query, frame, score, place: frames of ranked hits by quality, fading with the hit's rank, charts preferred; each frame once, at its best."""
    score = F.round((0.45 + 0.55 * F.col(quality)) / (1 + 0.35 * (F.col(rank) - 1)) * F.when(chart, 1.25).otherwise(1.0), 6)
    once = frames.withColumn("score", score).groupBy(query, frame).agg(F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), frame))).where(F.col("place") <= limit)


FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def recovered_json(text: str | None) -> str | None:
    """The first JSON object or list in a text, fenced or not, with trailing commas and curly quotes mended; None without one."""
    if not text:
        return None
    fenced = FENCE.search(text)
    body = (fenced[1] if fenced else text).translate(str.maketrans("“”‘’", "\"\"''"))
    decoder = json.JSONDecoder()
    for candidate in (body, re.sub(r",(\s*[}\]])", r"\1", body)):
        for m in re.finditer(r"[{\[]", candidate):
            try:
                return json.dumps(decoder.raw_decode(candidate, m.start())[0])
            except ValueError:
                continue
    return None


def recovered_json_column(text: Column) -> Column:
    """``recovered_json`` over Arrow batches; well-formed text stays on the JVM by way of the coalesce in front."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(recovered_json)

    return run(text)

