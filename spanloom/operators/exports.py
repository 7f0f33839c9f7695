"""Transcript, table and archive exports as text, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_cue, cue_time, guard_formula
from .intervals import runs


def _joined(df: DataFrame, group: str, order: str, line: Column, between: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(group).agg(F.array_join(lines, between).alias("body"))


def _said(speaker: str) -> Column:
    return F.coalesce(F.col(speaker), F.lit("")) != ""


def to_srt(df: DataFrame, group: str, order: str, start: str = "start", end: str = "end", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """group, body: numbered cues in order."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(group).orderBy(order))
    body = F.concat(F.when(_said(speaker), F.concat(F.lit("["), F.col(speaker), F.lit("] "))).otherwise(""), clean_cue(F.col(text)))
    cue = F.concat(F.col("__n").cast("string"), F.lit("\n"), cue_time(F.col(start)), F.lit(" --> "), cue_time(F.col(end)), F.lit("\n"), body, F.lit("\n"))
    return _joined(df.withColumn("__n", n), group, order, cue, "\n")


def to_vtt(df: DataFrame, group: str, order: str, start: str = "start", end: str = "end", speaker: str = "speaker", text: str = "text") -> DataFrame:
    body = F.concat(F.when(_said(speaker), F.concat(F.lit("<v "), F.col(speaker), F.lit(">"))).otherwise(""), clean_cue(F.col(text)))
    cue = F.concat(cue_time(F.col(start), "."), F.lit(" --> "), cue_time(F.col(end), "."), F.lit("\n"), body, F.lit("\n"))
    return _joined(df, group, order, cue, "\n").withColumn("body", F.concat(F.lit("WEBVTT\n\n"), F.col("body")))


def to_text(df: DataFrame, group: str, order: str, start: str = "start", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """group, body: a paragraph for each run of one speaker, with its time and name."""
    marked = runs(df, group, [order], speaker)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), clean_cue(F.col(text)).alias("l")))), lambda x: x["l"])
    para = marked.groupBy(group, "run").agg(F.min_by(start, order).alias("s"), F.first(speaker).alias("who"), F.array_join(parts, " ").alias("said"))
    stamp = F.substring(cue_time(F.col("s"), "."), 1, 8)
    line = F.concat(F.lit("["), stamp, F.lit("] "), F.when(_said("who"), F.concat("who", F.lit(": "))).otherwise(""), "said")
    return _joined(para, group, "run", line, "\n\n")


def csv_cell(c: Column, text: bool = True) -> Column:
    """A cell as CSV writes it; text that a spreadsheet would run is guarded, quotes and line ends are quoted. Null is empty."""
    plain = F.coalesce(guard_formula(c) if text else c.cast("string"), F.lit(""))
    return F.when(plain.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(plain, '"', '""'), F.lit('"'))).otherwise(plain)


def plain_number(c: Column) -> Column:
    """A double as text without an exponent, to ten places where Spark would write one."""
    long = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when((F.abs(c) < 1e-3) & (c != 0) | (F.abs(c) >= 1e7), F.coalesce(long, c.cast("string"))).otherwise(c.cast("string"))


def csv_row(df: DataFrame, columns: dict[str, Column]) -> Column:
    """One line: strings are guarded, arrays joined by |, booleans 0 or 1, numbers as they are."""
    cells = []
    for name, c in columns.items():
        kind = df.select(c.alias(name)).schema[0].dataType.simpleString()
        if kind.startswith("array"):
            cells.append(csv_cell(F.array_join(c, "|")))
        else:
            shown = c.cast("int") if kind == "boolean" else plain_number(c) if kind in ("double", "float") else c
            cells.append(csv_cell(shown, kind == "string"))
    return F.concat_ws(",", *cells)


def bundle(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], schema: str) -> DataFrame:
    """key, body: one JSON document per parent row with its children nested in order; children without rows are empty lists."""
    out = parent.select(F.col(key), F.struct(*parent.columns).alias("record"))
    names = []
    for name, (df, order) in children.items():
        cols = [c for c in df.columns if c != key]
        rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("x")))), lambda v: v["x"])
        out = out.join(df.groupBy(key).agg(rows.alias(name)), key, "left")
        names.append(F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)).alias(name))
    return out.select(key, F.to_json(F.struct(F.lit(schema).alias("schema"), F.col("record"), *names)).alias("body"))


#: The columns of each table as CSV, and to how many places their numbers are rounded.
CSV_TABLES = {
    "segments": {"index": None, "start_s": 3, "end_s": 3, "speaker": None, "confidence": 4, "text": None},
    "chunks": {"index": None, "start_s": 3, "end_s": 3, "duration_s": 3, "speakers": None, "keywords": None, "keyframes": None, "words_per_s": 3, "visual_activity": 3, "text": None},
    "scenes": {"index": None, "start_s": 3, "end_s": 3, "duration_s": 3, "kind": None, "cut_score": 3, "static_ratio": 3},
    "keyframes": {"id": None, "scene": None, "timestamp_s": 3, "path": None, "width": None, "height": None, "quality": 4, "sharpness": 5, "entropy": 3, "text_density": 5, "is_slide": None},
}


def csv_lines(df: DataFrame, kind: str) -> Column:
    """A row of ``df`` as a line of one of CSV_TABLES, whose columns it must have."""
    return csv_row(df, {name: F.col(name) if digits is None else F.round(F.col(name), digits) for name, digits in CSV_TABLES[kind].items()})


def csv_header(kind: str) -> str:
    return ",".join(CSV_TABLES[kind])
