"""Readers of transcripts (SRT, WebVTT, JSON), their discovery and fallback order. All are column expressions over file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_time

LEAST_SECONDS = 0.2
WORD = "struct<word:string,text:string,start:double,end:double,probability:double,prob:double>"
ITEM = f"struct<start:double,from:double,end:double,to:double,text:string,speaker:string,words:array<{WORD}>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under a path; contents stay whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def cues_of(content):
    """``array<struct<start, end, speaker, text>>`` of every cue with a time line and a body, in order; null contents have none."""
    blocks = F.split(F.trim(F.regexp_replace(content, "\r\n", "\n")), r"\n\s*\n")

    def cut(block):
        lines = F.filter(F.split(block, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.upper(F.trim(x)), F.lit("WEBVTT")))
        times = F.filter(lines, lambda x: F.contains(x, F.lit("-->")))
        body = F.filter(lines, lambda x: ~F.contains(x, F.lit("-->")) & ~F.trim(x).rlike("^[0-9]+$"))
        return F.struct(F.get(times, F.lit(0)).alias("time"), F.trim(F.array_join(body, " ")).alias("body"))

    def cue(c):
        time, body = c["time"], c["body"]
        start = parse_time(F.trim(F.split_part(time, F.lit("-->"), F.lit(1))))
        end = parse_time(F.split_part(F.trim(F.split_part(time, F.lit("-->"), F.lit(2))), F.lit(" "), F.lit(1)))
        square, voice = r"(?s)^\[([^\]]*)\](.*)$", r"(?s)^<v ([^>]+)>(.*)$"
        named = [(body.rlike(p), F.regexp_extract(body, p, 1), F.regexp_extract(body, p, 2)) for p in (square, voice)]
        speaker = F.when(named[0][0], F.trim(named[0][1])).when(named[1][0], F.trim(named[1][1]))
        rest = F.when(named[0][0], named[0][2]).when(named[1][0], named[1][2]).otherwise(body)
        return F.struct(start.alias("start"), F.greatest(end, start + LEAST_SECONDS).alias("end"), speaker.alias("speaker"), F.trim(F.regexp_replace(rest, "<[^>]+>", "")).alias("text"))

    timed = F.filter(F.transform(blocks, cut), lambda c: c["time"].isNotNull())
    return F.filter(F.transform(timed, cue), lambda c: c["text"] != "")


def parse_cues(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, idx, start, end, speaker, text of every cue; one narrow pass, so that streams can be read by it, too."""
    each = files.select(F.col(path).alias("path"), F.posexplode(cues_of(F.col(content))).alias("idx", "c"))
    return each.select("path", "idx", "c.start", "c.end", "c.speaker", "c.text")


def parse_json(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The same columns and words of JSON transcripts: a list of segments, or an object that holds it; broken ones have none."""
    direct = F.from_json(content, f"array<{ITEM}>")
    nested = F.from_json(content, f"struct<segments:array<{ITEM}>>")["segments"]
    items = F.when(F.trim(F.col(content)).startswith("{"), nested).otherwise(direct)
    i = files.select(F.col(path).alias("path"), F.posexplode(items).alias("idx", "x"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    i = i.withColumn("start", F.coalesce(zero("x.start"), F.col("x.from"), F.lit(0.0)))
    i = i.withColumn("end", F.coalesce(zero("x.end"), zero("x.to"), F.col("start") + 1.0))
    words = F.transform(
        F.coalesce("x.words", F.array().cast(f"array<{WORD}>")),
        lambda w: F.struct(
            F.trim(F.coalesce(w["word"], w["text"], F.lit(""))).alias("text"),
            F.coalesce(w["start"], F.col("start")).alias("start"),
            F.coalesce(w["end"], F.col("end")).alias("end"),
            F.coalesce(w["probability"], w["prob"], F.lit(0.9)).alias("prob"),
        ),
    )
    i = i.select("path", "idx", "start", "end", F.col("x.speaker").alias("speaker"), F.trim("x.text").alias("text"), F.filter(words, lambda w: w["text"] != "").alias("words"))
    timed = F.when(F.size("words") > 0, F.col("words")).otherwise(timed_words(F.col("text"), F.col("start"), F.col("end")))
    return i.where("text <> ''").withColumn("words", timed)


def timed_words(text, start, end):
    """Words with times in proportion to their lengths, one more for the gap."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    length = F.greatest(end - start, F.lit(1e-3))

    def spread(b):
        def word(w, i):
            # to the millisecond by whole numbers: rounding to three places goes by decimal digits, which other engines do not
            at = lambda k: F.round((b["start"] + F.get(b["at"], k) / F.element_at(b["at"], -1) * b["length"]) * 1000) / 1000
            return F.struct(w.alias("text"), at(i).alias("start"), at(i + 1).alias("end"), F.lit(0.9).alias("prob"))

        return F.transform(b["words"], word)

    # words and the lengths up to each are bound as the one element of an array: within a function of each word they would be made anew for every word
    upto = lambda ws: F.aggregate(ws, F.array(F.lit(0)), lambda at, w: F.concat(at, F.array(F.element_at(at, -1) + F.length(w) + 1)))
    bound = F.transform(F.array(words), lambda ws: F.struct(ws.alias("words"), upto(ws).alias("at"), start.alias("start"), length.alias("length")))
    return F.transform(bound, spread)[0]


def sidecars(media: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Every media path with the transcript beside it: same name with .srt, .vtt or .json, appended or in place of the suffix; null without one."""
    m = media.select(F.col(path).alias("media"), F.regexp_replace(path, r"\.[^./]*$", "").alias("stem"))
    options = F.array(*[F.struct(F.lit(i).alias("priority"), F.concat(base, F.lit(s)).alias("sidecar")) for i, (s, base) in enumerate((s, F.col(b)) for s in (".srt", ".vtt", ".json") for b in ("stem", "media"))])
    wanted = m.select("media", F.explode(options).alias("o")).select("media", "o.*")
    found = wanted.join(files.select(F.col(path).alias("sidecar")).distinct(), "sidecar").groupBy("media").agg(F.min_by("sidecar", "priority").alias("sidecar"))
    return m.select("media").join(found, "media", "left")


def first_available(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of the first source that has the key; ``degraded`` is true beyond the first."""
    all_rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("__p", F.lit(i))
        all_rows = s if all_rows is None else all_rows.unionByName(s, allowMissingColumns=True)
    best = F.min("__p").over(W.partitionBy(key))
    return all_rows.withColumn("__b", best).where("__p = __b").withColumn("degraded", F.col("__p") > 0).drop("__p", "__b")
