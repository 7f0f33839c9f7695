"""Steps whose cost grew faster than their input: they are bounded now, with the same rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from spanloom.operators import bm25, intervals, scans
from spanloom.streaming import timers


def corpus(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "one", "twenty", "20", "it's", "x-y", "rare1", "Delta"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    rows = [(i, texts[i % 40], ("en", "de", None)[i % 3]) for i in range(60)] + [(90, None, "en"), (91, "!!", "en"), (92, "zzz", "de")]
    items = [(1, "alpha beta twenty"), (2, "x-y x-y rare1 nowhere"), (3, "zzz"), (4, None), (5, "unheard"), (6, "it's DELTA")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def rows_of(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def test_top_lists_equal_scored_pairs_without_joining_them(spark, monkeypatch):
    docs, items = corpus(spark)
    cols = ("query", "doc", "score", "rank")
    want = {k: rows_of(bm25.top_k(bm25.scores(docs, items, c), 5), *cols) for k, c in {"all": None, "english": F.col("lang") == "en"}.items()}
    again = docs.unionByName(docs.where("doc_id < 3"))
    twice = rows_of(bm25.top_k(bm25.scores(again, items), 5), *cols)
    assert rows_of(bm25.top(again, items, 5), *cols) == twice  # an id in several rows
    monkeypatch.setattr(bm25, "scores", None)
    monkeypatch.setattr(bm25, "TEXTS", 7)
    monkeypatch.setattr(bm25, "QUERIES", 2)
    monkeypatch.setattr(bm25, "CELLS", 20)
    got = bm25.top_lists(docs, items, 5, {"all": F.lit(True), "english": F.col("lang") == "en"})
    assert {k: rows_of(got.where(F.col("list") == k), *cols) for k in want} == want
    assert bm25.top(docs.limit(0), items).collect() == [] == bm25.top(docs, items.limit(0)).collect()


def test_index_is_searched_without_joining_pairs(spark, tmp_path, monkeypatch):
    docs, items = corpus(spark)
    path = str(tmp_path / "index")
    bm25.add_documents(docs, path)
    bm25.delete_documents(spark, docs.where("lang = 'de'"), path)
    bm25.compact(spark, path)
    want = rows_of(bm25.top_k(bm25.search_index(spark, path, items), 5), "query", "doc", "score", "rank")
    monkeypatch.setattr(bm25, "_scored", None)
    assert rows_of(bm25.search_index_top(spark, path, items, 5), "query", "doc", "score", "rank") == want


def test_postings_are_counted_within_the_row(spark):
    docs, _ = corpus(spark)
    assert "Aggregate" not in bm25.postings(docs)._jdf.queryExecution().executedPlan().toString()
    tokens = bm25.tokenized(docs, "doc_id", "text").select("doc", F.size("t").cast("long").alias("len"), F.explode("t").alias("term"))
    want = tokens.groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    assert rows_of(bm25.postings(docs).withColumn("len", F.col("len").cast("long")), "doc", "term", "len", "tf") == rows_of(want, "doc", "term", "len", "tf")


def test_many_small_groups_share_a_call(spark, monkeypatch):
    """Blocks of many groups in one Python call, groups without a name and ids too long for a double among them."""
    big = 2**60
    rows = [(g, float(i * 3), big + (g or 0) * 1000 + i, 0.9 if i == 20 else 0.01) for g in (None, *range(30)) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, t double, id long, d double")
    frames = scans.numbered(df, "g", ["t", "id"])
    monkeypatch.setattr(type(df.groupBy("g")), "applyInPandas", None)  # a call per group and block
    assert sorted(r.id for r in scans.spikes(frames, "g", "id", "d").where("spike > 0").collect()) == sorted(i for _, t, i, d in rows if d > 0.5)
    for block in (4, 4096):
        got = scans.thinned(frames, "g", "t", "id", 10.0, block=block).collect()
        assert sorted((r.g is None, r.id) for r in got) == sorted((g is None, i) for g, t, i, _ in rows if t % 12 == 0)


def test_best_overlaps_equal_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), float(s := rng.randint(0, 40)), s + rng.choice([0.0, 1.0, 3.0, 20.0])) for i in range(300)] + [(900, None, 0.0, 9.0), (901, "c", 0.0, 9.0), (902, "a", 5.0, 4.0), (903, "b", None, 4.0)]
    df = spark.createDataFrame(rows, "id long, g string, start double, end double").withColumn("twice", 2 * F.col("id"))
    pairs = intervals.best_overlap(intervals.overlap_join(df, df, "g", 7.0, condition=F.col("l_id") != F.col("r_id"), empty=True), "id", "id")
    want = sorted((r.l_id, r.r_id, 2 * r.r_id, r.overlap) for r in pairs.collect())
    monkeypatch.setattr(intervals, "overlap_join", None)
    for bucket, call in ((7.0, 50), (1000.0, 50_000)):
        monkeypatch.setattr(intervals, "CALL", call)
        got = intervals.best_of_others(df, "g", "id", bucket, "twice").collect()
        assert sorted(map(tuple, got)) == want


def test_rows_of_a_batch_are_held_in_one_call():
    calls = []

    class State:
        def __init__(self, *_):
            self.value = None

        def get(self):
            calls.append("get")
            return iter(self.value or []) if isinstance(self.value, list) or self is machine.waiting else self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        put = update

        def appendList(self, values):
            calls.append("append")
            self.value = [*(self.value or []), *values]

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        getListState = getValueState = lambda self, *a: State(*a)

        def registerTimer(self, ms):
            calls.append("timer")

    class Now:
        getCurrentWatermarkInMs = lambda self: 500

    machine = timers.OrderedLevels("user_id", "id", "delta", 10**9)
    machine.init(Handle())
    rows = pd.DataFrame({"ts": pd.to_datetime(list(range(1000)), unit="ms"), "id": range(1000), "delta": [0.5 if i == 300 else 0.0 for i in range(1000)]}).sample(frac=1, random_state=1)
    list(machine.handleInputRows((7,), iter([rows]), Now()))
    out = pd.concat(machine.handleExpiredTimer((7,), Now(), None))
    assert len(calls) < 25 and out["id"].tolist() == list(range(501)) and out["id"][out["spike"] > 0].tolist() == [300]
    assert len(machine.waiting.value) == 499
