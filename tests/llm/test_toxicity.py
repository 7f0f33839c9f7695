"""The toxicity classifier: n-grams and ratios against plain Python, scores against held-out labels."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import toxicity as X


def plain_buckets(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).strip()
    if not words:
        return set()
    marked, mask, found = f" {words} ", (1 << 64) - 1, set()
    for n in X.ORDERS:
        for i in range(len(marked) - n + 1):
            h = ord(marked[i])
            for c in marked[i + 1 : i + n]:
                h = (h * int(X.ROLL) + ord(c)) & mask
            found.add(((h ^ (h >> 29)) * int(X.MIX) & mask) >> (64 - X.BITS))
    return found


@pytest.mark.parametrize("window", [16, X.WINDOW])
def test_distinct_buckets_in_any_windows(monkeypatch, window):
    monkeypatch.setattr(X, "WINDOW", window)
    grams = X.Grams()
    for text in ("", "  \n", "a", "ab", "Abc_abc", "élan \U0001f600 x", "the cat sat on the mat " * 9, "İstanbul ẞ", "x" * 100, "\x00\x85 áb"):
        got = grams.of(text).tolist()
        assert len(got) == len(set(got)) and set(got) == plain_buckets(text)


def test_ratios_and_telling_buckets():
    toxic, other = np.array([9.0, 5, 0, 10]), np.array([0.0, 50, 90, 100])
    p, q = [10, 6, 1, 11], [1, 51, 91, 101]
    assert np.allclose(X.log_ratios(toxic, other), [math.log(a / sum(p)) - math.log(b / sum(q)) for a, b in zip(p, q)])

    def gain(a, b, n1, n0):
        n = n1 + n0
        cells = [(a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)]
        return sum(c * math.log(c * n / (x * y)) for c, x, y in cells if c)

    want = sorted(range(4), key=lambda k: -gain(toxic[k], other[k], 10, 100))
    assert X.telling(toxic, other, 10, 100, 2).tolist() == sorted(want[:2])
    assert 3 not in X.telling(toxic, other, 10, 100, 4)  # stands everywhere and tells nothing


def test_regression_goes_down_the_penalised_loss():
    rng = np.random.default_rng(3)
    labels = (rng.random(200) < 0.3).astype(float)
    docs = [np.flatnonzero(rng.random(12) < np.where(np.arange(12) < 4, 0.2 + 0.6 * y, 0.4)) for y in labels]
    ratios = np.where(np.arange(12) < 4, 1.5, 0.1)
    dense = np.zeros((200, 12))
    for i, d in enumerate(docs):
        dense[i, d] = ratios[d]

    def loss(w, b):
        z = dense @ w + b
        return np.mean(np.logaddexp(0, z) - labels * z) + X.PENALTY / 2 * (w @ w)

    w, b = X.regression(docs, labels, ratios, steps=3000)
    for _ in range(50):
        assert loss(w, b) <= loss(w + 0.05 * rng.normal(size=12), b + 0.05 * rng.normal()) + 1e-6
    assert X.regression([np.zeros(0, int)] * 3, np.array([0.0, 1, 0]), np.ones(2))[0].tolist() == [0, 0]


def folds(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return docs, labels


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = folds(spark, sf_dir)
    rows = X.op13_char_ngram_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.88
    assert sum(r.predicted for r in clean) / len(clean) < 0.01


def test_held_out_labels_are_never_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id"), X.FOLD), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, turned)
    assert (a.scalars == b.scalars).all() and a.bias == b.bias
    seen = docs.join(labels.where(~X.held_out(F.col("doc_id"), X.FOLD) & (F.col("toxic") == 1)), "doc_id").select("doc_id", "text").collect()
    grams = X.Grams()
    for r in seen[:3]:
        z = a.bias + sum(a.scalars[k] for k in plain_buckets(r.text or ""))
        got = X.score_documents(spark.createDataFrame([r]), a).first().score
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-6) and len(grams.of(r.text)) == len(plain_buckets(r.text))


def test_odd_rows_and_tables(spark):
    rows = [(i, f"nice words number {i}", 0) for i in range(60)] + [(i, f"you awful creep {i}", 1) for i in range(60, 90)]
    odd = [(None, "you awful creep", None), (100, None, None), (101, "", None), (102, "\n\n", None), (103, "awful creep " * 200_000, None), (104, "you awful creep", None), (104, "you awful creep", None)]
    odd += [(7, "nice words number 7", 0)] * 50
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + odd], "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS label", "2 AS id")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (6, 7), (9, 0), (9, 0)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = X.score_documents(docs, model, keep=("doc_id", "text", "label", "score"))
    assert got.columns == ["doc_id", "text", "label", "score"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        if r.text and "creep" in r.text:
            assert r.score >= 0.3
        else:
            assert r.score < 0.3
    empty, none = docs.limit(0), labels.limit(0)
    assert X.score_documents(empty, model).collect() == []
    assert {r.score < 1e-9 for r in X.score_documents(docs, X.fit(docs, none)).collect()} == {True}
    assert {r.score < 1e-9 for r in X.score_documents(docs, X.fit(docs, labels.where("toxic = 0"))).collect()} == {True}
    assert {r.score > 0.99 for r in X.score_documents(docs, X.fit(empty, labels)).collect()} == {False}
