"""What the review of round 3 found, each on a small input that showed it."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom import catalogue
from spanloom.operators import intervals, records, terms
from spanloom.plans import interchange
from spanloom.sources import subtitles, transcripts
from spanloom.streaming import stateful


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Events of which some last no time: strictly within another, at its bounds, alone, and twice at once."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(1, 100, "a", 50.0), (2, 120, "a", 0.0), (3, 100, "a", 0.0), (4, 150, "a", 0.0), (5, 300, "a", 0.0), (6, 300, "a", 0.0), (7, 300, "a", 20.0), (8, 310, "a", 5.0), (9, 590, "a", 700.0), (10, 1200, "a", 0.0), (11, 120, "b", 0.0), (12, 120, "signup", 9.0), (13, 125, "signup", 0.0), (14, 320, "a", 0.0)]
    values = ", ".join(f"({i}, make_timestamp({t} * 1000000), {i % 3}, '{k}', {v}::DOUBLE)" for i, t, k, v in rows)
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v AS value FROM (VALUES {values}) x(i, t, u, k, v)) TO '{folder}/events.parquet'")
    return str(folder)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    df = catalogue.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    got = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert ours == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())


@pytest.mark.parametrize("name", ["best_overlap", "speaker_assignment", "interval_overlap_join", "span_text_concat"])
def test_spans_without_length_overlap(spark, odd_events, name):
    same_as_sql(spark, odd_events, name)


def test_spans_without_length_are_covered(spark, odd_events):
    same_as_sql(spark, odd_events, "coverage_union")
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 3.0, 3.0), (1, 5.0, 5.0), (1, 5.0, 6.0), (1, 9.0, 9.0)], "g int, start double, end double")
    assert sorted((r.start, r.end) for r in intervals.coverage(df, "g", empty=True).collect()) == [(0.0, 5.0), (5.0, 5.0), (5.0, 6.0), (9.0, 9.0)]


def test_long_ways_are_put_together_once(spark, monkeypatch):
    n, rows = 100, []
    df = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(0, None)], "node long, needs long")
    distinct = type(df).distinct
    monkeypatch.setattr(type(df), "distinct", lambda self: (rows.append(self.count()), distinct(self))[1])
    got = {(r.node, r.ancestor) for r in records.graph_ancestors(df).collect()}
    assert got == {(a, b) for a in range(n) for b in range(a)}
    assert sum(rows) < 5 * len(got)
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "node long, needs long")
    assert {(r.node, r.ancestor) for r in records.graph_ancestors(ring).collect()} == {(a, b) for a in range(5) for b in range(5)}


def test_many_transcripts_in_a_file(spark, sf_dir, tmp_path):
    folder = interchange._filed(spark, sf_dir)
    videos = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    files = sum(len([f for f in names if not f.startswith((".", "_"))]) for _, _, names in os.walk(folder.removeprefix("file:")))
    assert 0 < files <= 3 * 4 < videos
    body = "1\n00:00:01,000 --> 00:00:02,500\n[Bo] hello there\n"
    docs = spark.createDataFrame([(f"v{i}", "srt", body) for i in range(6)] + [("007", "json", '[{"start": 4, "end": 9, "text": "hi"}]'), ("x", "doc", "x"), ("y", "vtt", None)], "video string, format string, body string")
    single, packs = str(tmp_path / "single"), str(tmp_path / "packs")
    transcripts.write_transcripts(docs, single)
    transcripts.write_packs(docs, packs)
    want = sorted(map(repr, transcripts.read_transcripts(spark, single).collect()))
    assert len(want) == 7 and sorted(map(repr, transcripts.read_packs(spark, packs).collect())) == want
    assert sorted(map(repr, stateful.drain(transcripts.stream_packs(spark, packs, per_trigger=2)).collect())) == want


def test_word_times_round_as_in_sql(spark):
    text = " ".join(["x" * 973, "y" * 625])
    words = spark.createDataFrame([(text,)], "t string").select(subtitles.timed_words(F.col("t"), F.lit(10.0), F.lit(20.0)).alias("w")).first().w
    assert words[1].start == duckdb.sql("SELECT round(10::DOUBLE + 974::DOUBLE / 1600 * 10, 3) AS s").fetchall()[0][0] == 16.087


def test_terms_are_counted_within_the_row(spark):
    df = spark.createDataFrame([("v", 1, "vector index vector index alpha"), ("v", 2, "beta"), ("v", 3, None), ("v", 4, "the of")], "g string, i int, t string")
    counts = terms.term_counts(df, "g", "i", "t")
    assert "Aggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.term): (r.tf, r.total, r.phrase) for r in counts.collect()}
    assert got == {(1, "vector"): (2, 9, False), (1, "index"): (2, 9, False), (1, "alpha"): (1, 9, False), (1, "vector index"): (2, 9, True), (1, "index vector"): (1, 9, True), (1, "index alpha"): (1, 9, True), (2, "beta"): (1, 1, False)}


def test_scores_are_the_same_without_broadcasts(spark, monkeypatch):
    df = spark.createDataFrame([("v", 1, "vector index vector index alpha"), ("v", 2, "alpha beta beta"), ("w", 3, "beta gamma")], "g string, i int, t string")
    want = sorted(map(repr, terms.keyword_scores(df, "g", "i", "t").collect()))
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 0)
    assert len(want) > 5 and sorted(map(repr, terms.keyword_scores(df, "g", "i", "t").collect())) == want
