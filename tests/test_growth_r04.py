"""Steps that failed by disk or time at 6 GB: they are bounded now, with the same rows."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions.text import STOP_WORDS
from spanloom.operators import intervals, terms, vocabulary

from test_findings_r03 import same_as_sql


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_ids_of_overlapping_spans_equal_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), float(s := rng.randint(0, 40)), s + rng.choice([0.0, 1.0, 3.0, 20.0])) for i in rng.sample(range(1000), 300)]
    rows += [(2000, None, 0.0, 9.0), (2001, "c", 0.0, 9.0), (2002, "a", 5.0, 4.0), (2003, "b", None, 4.0), (2004, "c", 3.0, 3.0), (2005, "c", 0.0, 0.0), (2006, "d", 5.0, 5.0), (2007, "d", 5.0, 5.0), (2008, "e", -9.0, 60.0), (2009, "e", 41.0, 41.5)]
    df = spark.createDataFrame(rows, "id long, g string, start double, end double")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "r_id"))), lambda x: x["r_id"].cast("string")), " ")
    want = rows_of(intervals.overlap_join(df, df, "g", 7.0, empty=True).groupBy(F.col("l_id").alias("id")).agg(text.alias("text"), F.count(F.lit(1)).alias("pieces")))
    assert len(want) > 200
    monkeypatch.setattr(intervals, "overlap_join", None)
    for bucket, call, crowd, pieces in ((7.0, 50, 50_000, 1_000_000), (7.0, 20, 9, 30), (1000.0, 50_000, 50, 1)):
        monkeypatch.setattr(intervals, "CALL", call)
        monkeypatch.setattr(intervals, "CROWD", crowd)
        monkeypatch.setattr(intervals, "PIECES", pieces)
        assert rows_of(intervals.overlapping_ids(df, "g", "id", bucket)) == want
    assert intervals.overlapping_ids(df.limit(0), "g", "id", 7.0).collect() == []


def test_texts_of_spans_come_without_their_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(intervals, "overlap_join", None)
    same_as_sql(spark, sf_dir, "span_text_concat")


def test_texts_of_spans_whose_ids_recur(spark, tmp_path):
    rows = "(1, 100, 50.0), (1, 120, 10.0), (2, 110, 5.0), (NULL, 112, 1.0)"
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, make_timestamp(t * 1000000) AS ts, 1::BIGINT AS user_id, 'a' AS event_type, v::DOUBLE AS value FROM (VALUES {rows}) x(i, t, v)) TO '{tmp_path}/events.parquet'")
    same_as_sql(spark, str(tmp_path), "span_text_concat")


def test_blocks_of_pieces_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    start, order = rng.integers(0, 50, 200).astype(float), rng.permutation(200)
    end = start + rng.choice([0.0, 2.0, 9.0], 200)
    mine, home = order % 3 == 0, start >= 10
    want = [(i, [j for j in np.lexsort([order, start]) if start[i] < end[j] and end[i] > start[j] and (home[i] or home[j])]) for i in range(200) if mine[i]]
    for most in (1, 40, 1_000_000):
        monkeypatch.setattr(intervals, "PIECES", most)
        got, longest = [], max(len(js) for _, js in want)
        for at, number, pieces in intervals.overlapping(start, end, order, home, mine):
            assert number.sum() == len(pieces) <= max(most, longest)
            got += zip(at.tolist(), [p.tolist() for p in np.split(pieces, np.cumsum(number)[:-1])], strict=True)
        assert sorted(got) == [(i, list(map(int, js))) for i, js in want if js]


def corpus(spark):
    """Texts with ties, terms of every text, phrases that recur, characters beyond ASCII and groups of one text."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma's", "the", "x-y", "9lives", "Überlauf", "ab", "delta", "a" * 90, "vector", "index"]
    rows = [(i, "pqr"[i % 3], " ".join(["alpha", *rng.choices(words, k=rng.randint(0, 25))])) for i in range(90)]
    rows += [(100, "one", "vector index vector index alpha"), (101, "two", "solo"), (102, "three", None), (103, None, "lost lost"), (104, "p", ""), (105, "p", "the of")]
    return spark.createDataFrame(rows, "i long, g string, t string").repartition(3)


def test_words_of_a_block_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aB0'- \n\u00e9Thezx", k=rng.randint(0, 40))) for _ in range(2000)] + ["", "The the", "9-'abc", "a'b-", "abc", "def", "x" * 200, "\u0130K abc\u212a", "", "--", "12"]
    words, codes, text = vocabulary.content_words(pa.array(["before", *texts]).slice(1))
    got = [[] for _ in texts]
    for code, at in zip(codes, text, strict=True):
        got[at].append(words[code].as_py())
    assert got == [[w for w in map(str.lower, re.findall("[A-Za-z][A-Za-z0-9'-]+", x)) if len(w) >= 3 and w not in STOP_WORDS] for x in texts]
    assert got[texts.index("\u0130K abc\u212a")] == ["abc"]
    batch = pa.RecordBatch.from_pydict({"g": ["a"] * len(texts), "t": texts})
    parts = [part.column(1).to_pylist() for part, _ in vocabulary._blocks(iter([batch, batch.slice(0, 0)]), 0, 100)]
    assert sum(parts, []) == texts and all(len(x) == 1 or sum(len(t.encode()) for t in x) <= 100 for x in parts)


def test_topics_equal_those_of_shuffled_counts(spark, monkeypatch):
    df = corpus(spark)
    with monkeypatch.context() as m:
        m.setattr(terms, "repeated", lambda *_: True)
        want = rows_of(terms.topic_scores(df, "g", "i", "t"))
    assert len(want) > 20
    monkeypatch.setattr(terms, "keyword_scores", None)
    monkeypatch.setattr(terms, "term_counts", None)
    for names, collected in ((12_000_000, 2_000_000), (20, 7)):
        monkeypatch.setattr(vocabulary, "NAMES", names)
        monkeypatch.setattr(vocabulary, "COLLECTED", collected)
        assert rows_of(terms.topic_scores(df, "g", "i", "t")) == want
    assert terms.topic_scores(df.limit(0), "g", "i", "t").collect() == []


def test_topics_come_without_counts_by_text(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(terms, "keyword_scores", None)
    same_as_sql(spark, sf_dir, "topics_scores")


def test_topics_of_texts_whose_ids_recur(spark, tmp_path):
    texts = ["vector index vector index alpha", "vector index vector index alpha", "alpha beta beta", "gamma delta gamma", "alpha beta beta"]
    rows = ", ".join(f"({i}, '{t}', '{s}')" for i, t, s in zip((1, 1, 1, 2, "NULL"), texts, "aabaa", strict=True))
    duckdb.sql(f"COPY (SELECT i::BIGINT AS doc_id, t AS text, s AS source FROM (VALUES {rows}) x(i, t, s)) TO '{tmp_path}/documents.parquet'")
    same_as_sql(spark, str(tmp_path), "topics_scores")


def test_keywords_of_a_group_come_from_its_first_terms(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, "".join(rng.choices("ab", k=rng.randint(1, 9))), float(rng.randint(0, 5))) for g in "pq" for _ in range(80)] + [("r", "a" * k, float(k)) for k in range(1, 40)] + [("s", "x", 1.0)]
    df = spark.createDataFrame(sorted({(g, t): (g, t, s) for g, t, s in rows}.values()), "g string, term string, score double")
    want = rows_of(terms.keywords(df.withColumn("item", F.lit(0)), "g", "item", 8).drop("item"))
    read = []
    keywords = terms.keywords
    monkeypatch.setattr(terms, "keywords", lambda scores, *a: (read.append(scores.groupBy("g").count().collect()), keywords(scores, *a))[1])
    for first in (2_000, 30, 3):
        monkeypatch.setattr(terms, "FIRST_TERMS", first)
        read.clear()
        assert rows_of(terms.group_keywords(df, "g", 8)) == want
        assert max(r["count"] for r in read[0]) <= first and len(read) == (1 if first > 80 else 2)
    assert terms.group_keywords(df.limit(0), "g", 8).collect() == []
