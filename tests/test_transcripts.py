"""Transcript folders: what is written is read back, by batch, by filter and as a stream; odd files do no harm."""

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import assembly as asm
from spanloom.operators import exports
from spanloom.sources import transcripts as ts
from spanloom.streaming import stateful


def test_formats_give_the_same_rows(spark, tmp_path):
    segments = [("a", i, float(i), i + 0.5, "Ann" if i % 2 else None, f"line {i} <b>bold</b>" if i == 2 else f"line {i}") for i in range(5)]
    df = spark.createDataFrame(segments, "video string, n int, start double, end double, speaker string, text string")
    made = exports.to_srt(df, "video", "n").withColumn("format", F.lit("srt")).unionByName(exports.to_vtt(df, "video", "n").withColumn("format", F.lit("vtt"))).unionByName(ts.segments_json(df, "video", "n").withColumn("format", F.lit("json")))
    odd = spark.createDataFrame([("b", "srt", "no cue at all"), ("c", "json", "{broken"), ("d", "vtt", None), ("e", "doc", "x"), ("f é/=", "json", '{"segments": [{"from": 3, "text": " hi "}, {"start": 4, "end": 9, "text": ""}]}')], "video string, format string, body string")
    path = str(tmp_path / "t")
    ts.write_transcripts(made.unionByName(odd), path)
    rows = ts.read_transcripts(spark, path).collect()
    for form in ts.FORMATS:
        got = sorted((r.idx, r.start, r.end, r.speaker, r.text) for r in rows if r.video == "a" and r.format == form)
        strip = (lambda t: t) if form == "json" else (lambda t: t.replace("<b>", "").replace("</b>", ""))
        assert got == [(i, a, b, s, strip(t)) for _, i, a, b, s, t in segments], form
    assert [(r.idx, r.start, r.end, r.text) for r in rows if r.video == "f é/="] == [(0, 3.0, 4.0, "hi")]
    assert {r.video for r in rows} == {"a", "f é/="}
    first = next(r for r in rows if r.video == "a" and r.format == "srt" and r.idx == 1)
    assert [(w.text, w.start, w.end) for w in first.words] == [("line", 1.0, 1.357), ("1", 1.357, 1.5)]


def test_filters_skip_files_and_streams_read_them(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,500\n[Bo] hello there\n"
    docs = spark.createDataFrame([(f"v{i}", "srt", body) for i in range(6)], "video string, format string, body string")
    path = str(tmp_path / "t")
    ts.write_transcripts(docs, path)
    one = ts.read_transcripts(spark, path).where("video = 'v3'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "v3" in plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]
    assert [(r.video, r.text, r.speaker) for r in one.collect()] == [("v3", "hello there", "Bo")]
    stream = stateful.drain(ts.stream_transcripts(spark, path, per_trigger=2))
    assert sorted(r.video for r in stream.collect()) == [f"v{i}" for i in range(6)]


def test_csv_tables_and_scene_kinds(spark):
    df = spark.createDataFrame([(0, 1.23456, 2.0, 0.76544, ["a", "b"], ["k"], 2, 1.5, 0.25, '=1+"x"')], "index int, start_s double, end_s double, duration_s double, speakers array<string>, keywords array<string>, keyframes int, words_per_s double, visual_activity double, text string")
    assert df.select(exports.csv_lines(df, "chunks").alias("l")).first().l == '0,1.235,2.0,0.765,a|b,k,2,1.5,0.25,"\'=1+""x"""'
    small = spark.createDataFrame([(1e-4,), (2.5e7,), (0.0,), (-3e-9,), (1.5,), (None,)], "x double")
    assert [r.l for r in small.select(exports.csv_row(small, {"x": F.col("x")}).alias("l")).collect()] == ["0.0001", "25000000.0", "0.0", "-0.000000003", "1.5", ""]
    assert exports.csv_header("scenes") == "index,start_s,end_s,duration_s,kind,cut_score,static_ratio"
    kinds = spark.createDataFrame([(0.9, 0.5, 9), (0.1, 0.2, 9), (0.1, 0.2, 2), (0.5, 0.3, 9), (None, None, 0)], "s double, l double, n int")
    assert [r.k for r in kinds.select(asm.scene_kind(F.col("s"), F.col("l"), F.col("n")).alias("k")).collect()] == ["static", "fade", "cut", "cut", "cut"]
    stamps = spark.sql("SELECT timestamp_ntz'2024-02-03 04:05:06' AS t UNION ALL SELECT timestamp_ntz'2024-02-03 04:05:06.5' UNION ALL SELECT NULL")
    assert [r.s for r in stamps.select(tx.iso_utc(F.col("t")).alias("s")).collect()] == ["2024-02-03T04:05:06+00:00", "2024-02-03T04:05:06.500000+00:00", ""]
