"""Composites: chunks from segments, chapters, evidence and answers, and the expressions they use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clock
from . import intervals as iv
from . import sequential as seq

# Expressions over metric columns.


def is_slide(text_density: Column, entropy: Column) -> Column:
    return (text_density > 0.055) & (entropy < 6.2)


def visual_description(slides: Column, frames: Column, density: Column, entropy: Column) -> Column:
    """Words for what is on screen, from the number of slides and frames and the means of text density and entropy."""
    return (
        F.when(frames == 0, "no distinct visual")
        .when(slides >= F.greatest(F.lit(1), F.floor(frames / 2)), "slide or diagram on screen")
        .when(density > 0.04, "text-heavy visual on screen")
        .when(entropy > 6.0, "detailed camera shot")
        .otherwise("presenter shot")
    )


def scene_kind(static_ratio: Column, luma_spread: Column, frames: Column) -> Column:
    """static where hardly anything moves; fade where the light of more than two frames varies and little stands still; else cut. Nulls say nothing."""
    return F.when(static_ratio > 0.85, "static").when((frames > 2) & (luma_spread > 0.18) & (F.coalesce(static_ratio, F.lit(0.0)) < 0.2), "fade").otherwise("cut")


def frame_quality(sharpness: Column, entropy: Column, exposure: Column, text_density: Column) -> Column:
    """A blend of unit-scaled frame metrics."""
    return 0.34 * sharpness + 0.24 * entropy + 0.20 * exposure + 0.22 * text_density


def interval_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of two spans; 0 where both are empty."""
    overlap = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = interval_length(s1, e1) + interval_length(s2, e2) - overlap
    return F.when(union > 0, overlap / union).otherwise(0.0)


def speech_confidence(log_prob: Column, no_speech: Column) -> Column:
    return F.round(F.exp(F.greatest(F.lit(-6.0), F.least(F.lit(0.0), log_prob))) * (1 - no_speech), 4)


def minmax(value: str, group: str) -> Column:
    """Scaled to 0..1 within the group; all 1 where the group is constant."""
    w = W.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(1.0)


def rank_decay(rank: Column, slope: float) -> Column:
    return 1 / (1 + slope * rank)


def evidence_confidence(top: Column, second: Column, channels: Column, hits: Column, computed: Column, visual: Column, assisted: Column) -> Column:
    """How sure an answer is: margin, agreement of channels, amount of evidence, computed and seen evidence."""
    margin = F.when(top > 1e-9, (top - F.coalesce(second, F.lit(0.0))) / top).otherwise(0.0)
    raw = 0.34 * F.least(F.lit(1.0), 3 * margin) + 0.3 * channels / 4 + 0.2 * F.least(F.lit(1.0), hits / 5) + F.when(computed, 0.12).otherwise(0.0) + F.when(visual, 0.08).otherwise(0.0)
    return F.when(hits == 0, 0.0).otherwise(F.round(F.least(F.lit(0.97), raw) * F.when(assisted, 1.0).otherwise(0.85), 4))


def candidate_times(start: Column, end: Column, wanted: Column) -> Column:
    """Up to nine evenly spaced times inside a span, away from its ends; the middle of a very short one."""
    n = F.least(F.lit(9), F.greatest(F.lit(2), 3 * wanted)).cast("int")
    pad = F.least(F.lit(0.35), (end - start) * 0.12)
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + pad + i * (end - start - 2 * pad) / (n - 1))
    return F.when(end - start < 0.2, F.array((start + end) / 2)).otherwise(spaced)


def ordinal_index(question: Column) -> Column:
    """The number that an ordinal before "speaker", "person" and the like names: 0 for the first, -1 for the last; null without one."""
    word = F.lower(F.regexp_extract(question, r"(?i)\b(first|1st|second|2nd|third|3rd|fourth|4th|fifth|5th|last|final)\s+(?:speaker|person|presenter|panelist|voice)\b", 1))
    out = F.when(word.isin("last", "final"), -1)
    for i, names in enumerate((("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th"), ("fifth", "5th"))):
        out = out.when(word.isin(*names), i)
    return out


def ordinal_speaker(question: Column, speakers: Column) -> Column:
    """The speaker that an ordinal names in the sorted list; null where there is none."""
    i, ordered = ordinal_index(question), F.array_sort(F.array_distinct(speakers))
    return F.when(i >= 0, F.try_element_at(ordered, i + 1)).when(i < 0, F.try_element_at(ordered, F.lit(-1)))


def time_filter(question: Column) -> Column:
    """The range that "after 1:30" or "before 10:00" asks for, as a struct; hours, minutes and seconds are read as such. Null without one."""
    clock_time = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\b"

    def seconds(pattern: str) -> Column:
        a, b, c = (F.regexp_extract(question, pattern, k).try_cast("int") for k in (1, 2, 3))
        return F.when(c.isNotNull(), a * 3600 + b * 60 + c).otherwise(a * 60 + b).cast("double")

    after, before = seconds(rf"(?i)\b(?:after|from|since)\s+{clock_time}"), seconds(rf"(?i)\b(?:before|until|up to)\s+{clock_time}")
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    return F.when(after.isNotNull(), span(after, F.lit(1e6))).when(before.isNotNull(), span(F.lit(0.0), before))


def hue_slot(name: Column, slots: int = 8) -> Column:
    """A steady slot for a name: its 31-polynomial hash in 32 bits, modulo the slots."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))) % slots


def _shown(value: Column, digits: int, unit: str) -> Column:
    """The number to so many digits, halves upwards, and its unit."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f {unit}", F.floor(value * scale + 0.5) / scale)


def human_bytes(n: Column) -> Column:
    out = F.when(F.coalesce(n, F.lit(0)) == 0, "-")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        v = n / float(1024**i)
        text = _shown(v, 0, unit) if i == 0 else F.when(v >= 100, _shown(v, 0, unit)).otherwise(_shown(v, 1, unit))
        out = out.when(v < 1024, text) if unit != "TB" else out.otherwise(text)
    return out


def human_duration(t: Column) -> Column:
    return F.when(t >= 3600, _shown(t / 3600, 1, "h")).when(t >= 60, _shown(t / 60, 0, "min")).otherwise(_shown(t, 0, "s"))


def uniform_sample(df: DataFrame, group: str, order: str, capacity: int) -> DataFrame:
    """At most ``capacity`` rows a group, evenly spread over their order."""
    w = W.partitionBy(group)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    slot = F.floor((i + 1) * capacity / n) - F.floor(i * capacity / n)
    return df.withColumn("__n", n).withColumn("__s", slot).where((F.col("__n") <= capacity) | (F.col("__s") >= 1)).drop("__n", "__s")


# Chunks.


def chunk_spans(segments: DataFrame, scenes: DataFrame, group: str = "video_id", target: float = 22.0, longest: float = 45.0) -> DataFrame:
    """group, idx, start, end: spans cut at natural boundaries (scene starts, changes of speaker, ends of sentences, silences) by the cheapest segmentation."""
    w = W.partitionBy(group).orderBy("start", "idx")
    s = segments.withColumn("__p", F.lag("speaker").over(w)).withColumn("__n", F.lead("start").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    gap = F.col("__n") - F.col("end")
    options = F.array(
        F.when(~F.col("__first") & ~F.col("speaker").eqNullSafe(F.col("__p")), F.struct(F.col("start").alias("t"), F.lit(0.95).alias("q"))),
        F.when(F.col("text").rlike(r"[.!?]['\")\]]?\s*$"), F.struct(F.col("end").alias("t"), F.lit(0.62).alias("q"))),
        F.when(gap > 0.45, F.struct(((F.col("end") + F.col("__n")) / 2).alias("t"), F.least(0.45 + 0.06 * gap, F.lit(0.85)).alias("q"))),
        F.when(F.col("__first"), F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("q"))),
    )
    cuts = s.select(group, F.explode(options).alias("x")).where("x is not null").select(group, "x.t", "x.q")
    starts = scenes.where("start > 0").select(group, F.col("start").alias("t"), F.lit(1.0).alias("q"))
    ends = segments.groupBy(group).agg(F.max("end").alias("t")).withColumn("q", F.lit(1.0))
    chosen = seq.optimal_cuts(cuts.unionByName(starts).unionByName(ends), group, "t", "q", target, longest).unionByName(ends.select(group, "t"))
    spans = iv.boundaries_to_spans(chosen, group, "t", F.max("t"), 0.4)
    return spans.withColumn("idx", F.row_number().over(W.partitionBy(group).orderBy("start")) - 1)


def chunk_contents(spans: DataFrame, segments: DataFrame, group: str = "video_id", bucket: float = 60.0) -> DataFrame:
    """group, idx, start, end, text, speakers (in order of appearance), words_per_s of each span from the segments it overlaps."""
    j = iv.overlap_join(spans, segments, group, bucket)
    by_start = F.array_sort(F.collect_list(F.struct("r_start", "r_idx", "r_text", "r_speaker")))
    g = j.groupBy(f"l_{group}", "l_idx", "l_start", "l_end").agg(by_start.alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.trim(x["r_text"])), " ")
    speakers = F.array_distinct(F.filter(F.transform("s", lambda x: x["r_speaker"]), lambda x: x.isNotNull()))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    found = g.select(F.col(f"l_{group}").alias(group), F.col("l_idx").alias("idx"), text.alias("text"), speakers.alias("speakers"), words.alias("__w"))
    out = spans.join(found, [group, "idx"], "left")
    rate = F.round(F.coalesce("__w", F.lit(0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1e-3)), 3)
    return out.select(group, "idx", "start", "end", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), rate.alias("words_per_s"))


def frames_of_spans(spans: DataFrame, frames: DataFrame, group: str = "video_id", bucket: float = 60.0, time: str = "t", frame_id: str = "id") -> DataFrame:
    """group, idx, frames: the frames inside each span in order, or the nearest one to its middle where none is."""
    inside = iv.stab_join(frames.select(group, time, frame_id), spans, group, bucket, time)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(f"l_{time}", f"l_{frame_id}"))), lambda x: x[f"l_{frame_id}"])
    has = inside.groupBy(F.col(f"r_{group}").alias(group), F.col("r_idx").alias("idx")).agg(listed.alias("frames"))
    bare = spans.join(has.select(group, "idx"), [group, "idx"], "left_anti").select(group, "idx", ((F.col("start") + F.col("end")) / 2).alias(time))
    near = iv.nearest_join(bare, frames, group, bucket, time, frame_id).where("nearest_id is not null")
    return has.unionByName(near.select(group, "idx", F.array("nearest_id").alias("frames")))


def parent_links(chunks: DataFrame, children: str, child: str, parent: str, order: str) -> DataFrame:
    """child, parent: the last chunk that lists a child is its parent."""
    return chunks.select(F.explode(children).alias(child), parent, order).groupBy(child).agg(F.max_by(parent, order).alias(parent))


def neighbours(df: DataFrame, group: str, idx: str, row_id: str, radius: int) -> DataFrame:
    """id, near: rows of the group within ``radius`` places, the row itself left out."""
    near = df.select(F.col(group).alias("__g"), F.col(idx).alias("__i"), F.col(row_id).alias("near"))
    at = df.select(group, row_id, F.col(idx).alias("__own"), F.explode(F.sequence(F.col(idx) - radius, F.col(idx) + radius)).alias("__want"))
    return at.join(near, (F.col(group) == F.col("__g")) & (F.col("__want") == F.col("__i")) & (F.col("__own") != F.col("__i"))).select(row_id, "near")


# Chapters.


def accepted_cuts(gaps: DataFrame, group: str, gap: str, picked: str, least: int = 2) -> DataFrame:
    """group, gap of the picked gaps that leave ``least`` rows or more on both sides, judged in order from the last one accepted."""
    kind = gaps.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, start, out = len(pdf) + 1, 0, []
        for g in sorted(pdf[gap][pdf[picked]]):
            if g + 1 - start >= least and n - g - 1 >= least:
                out.append(g)
                start = g + 1
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(out), gap: out})

    return seq.per_group(gaps.select(group, gap, picked), group, run, f"{group} {kind}, {gap} int")


def chapters_of(rows: DataFrame, cuts: DataFrame, group: str, idx: str, gap: str) -> DataFrame:
    """Adds chapter, from 0: how many accepted cuts lie before a row."""
    marks = cuts.select(F.col(group).alias("__g"), (F.col(gap) + 1).alias("__i"), F.lit(1).alias("__c"))
    joined = rows.join(marks, (F.col(group) == F.col("__g")) & (F.col(idx) == F.col("__i")), "left")
    return joined.withColumn("chapter", F.sum(F.coalesce("__c", F.lit(0))).over(W.partitionBy(group).orderBy(idx).rowsBetween(W.unboundedPreceding, 0))).drop("__g", "__i", "__c")


# Evidence.


def ranked_sentences(hits: DataFrame, query_terms: str, sentences: str, limit: int = 6) -> DataFrame:
    """query, doc, sentence, score, place: the best sentences of ranked hits (query, doc, rank from 1, terms, sentences).

    A sentence scores by the query terms it has, over the root of its words, fading with the hit's
    rank; fewer than three words are no sentence, and the same opening counts once, at its best.
    """
    s = hits.select("query", "doc", "rank", F.col(query_terms).alias("q"), F.posexplode(sentences).alias("at", "sentence"))
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower("sentence"), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")))
    overlap = F.size(F.array_intersect(words, "q")) / F.sqrt(F.size(words))
    scored = s.where(F.size(F.filter(F.split("sentence", r"\s+"), lambda w: w != "")) >= 3).withColumn("score", F.round(rank_decay(F.col("rank") - 1, 0.4) * (0.25 + overlap), 6))
    key = F.substring(F.trim(F.regexp_replace(F.lower("sentence"), r"\s+", " ")), 1, 90)
    order = [F.desc("score"), F.col("rank"), F.col("at")]
    once = scored.withColumn("__k", F.row_number().over(W.partitionBy("query", key).orderBy(*order))).where("__k = 1")
    place = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return once.withColumn("place", place).where(F.col("place") <= limit).select("query", "doc", "sentence", "score", "place")


def filled_context(hits: DataFrame, budget: int = 2600) -> DataFrame:
    """query, bodies: texts of ranked hits (query, rank, text) in order until the token budget is spent; one takes at most 45 % of what is left, or 280 tokens."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(budget).alias("left"))

    def add(acc, t):
        share = F.greatest(F.lit(280), F.floor(acc["left"] * 0.45)).cast("int") * 4
        body = F.substring(t, F.lit(1), share)
        after = (acc["left"] - F.floor(F.length(body) / 4) - 40).cast("int")
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct(F.concat(acc["out"], F.array(body)).alias("out"), after.alias("left")))

    return hits.groupBy("query").agg(texts.alias("t")).select("query", F.aggregate("t", start, add, lambda a: a["out"]).alias("bodies"))


def job_order(jobs: DataFrame, priority: str, seq_col: str) -> DataFrame:
    """Adds turn: shortest first, then first come; one sort of the waiting jobs."""
    return jobs.withColumn("turn", F.row_number().over(W.orderBy(priority, seq_col)))


def line(start: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), clock(start), F.lit("] "), F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise(""), text)
