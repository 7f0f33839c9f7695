import os
from collections import Counter

import duckdb

from spanloom.llm import mixing


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    df = mixing.op4_poisson_mix(spark, sf_dir)
    got = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in got.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, got.fetchall()))


def test_target_shares_and_hot_source(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'b' ELSE NULL END AS source", "'t' AS text", "0 AS copy")
    rates = mixing.source_rates(df, {"hot": 1.0, "b": 1.0, "": 2.0})
    for limit in (1000, 0):  # broadcast, then the salted join: the same copies
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        rows = mixing.poisson_mix(df, rates).collect()
        share = Counter(r.source for r in rows)
        assert abs(len(rows) - 30_000) < 900
        assert abs(share["hot"] / len(rows) - 0.25) < 0.02 and abs(share[None] / len(rows) - 0.5) < 0.02
        copies = sorted((r.doc_id, r.copy) for r in rows)
        assert limit or copies == before
        before = copies
    assert len(set(copies)) == len(copies)
    order = [r.doc_id for r in rows]
    assert order != sorted(order)


def test_counts_follow_poisson(spark):
    """Against the distribution itself: the count is the number of cumulative probabilities that u reaches."""
    import math

    for mean in (0.0, 0.3, 5.0, 200.0):
        df = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source")
        rates = spark.createDataFrame([("s", 4000.0, mean)], "key string, mass double, rate double")
        n = mixing.poisson_mix(df, rates).count()
        assert abs(n - 4000 * mean) <= 6 * math.sqrt(4000 * mean)


def test_degenerate(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "a", None), (1, "a", None)], "doc_id long, source string, text string")
    rows = mixing.poisson_mix(df, spark.createDataFrame([("", 1.0, 3.0), ("a", 2.0, 3.0)], "key string, mass double, rate double")).collect()
    twins = [r.copy for r in rows if r.doc_id == 1]
    assert sorted(twins) == list(range(1, len(twins) + 1))  # copies of equal rows are numbered through
    empty = df.limit(0)
    assert mixing.poisson_mix(empty, mixing.source_rates(empty)).count() == 0
    assert mixing.poisson_mix(df, mixing.source_rates(df, {})).count() == 0
    sized = spark.createDataFrame([("a", None), ("b", 4)], "source string, n int")
    assert {r.key: r.rate for r in mixing.source_rates(sized, size_col="n").collect()} == {"a": 0.0, "b": 1.0}


def test_null_and_repeated_ids(spark, monkeypatch):
    """A source without ids meets its target, in several partitions; equal rows are drawn one by one; any names of columns."""
    df = spark.range(8_000).selectExpr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 7 ELSE id END AS doc_id", "CASE id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'own' END AS source", "concat('text ', id) AS text")
    rates = mixing.source_rates(df, {"none": 1.0, "one": 1.0, "own": 1.0})
    before = None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in (1, 7):
        placed = mixing.poisson_mix(df.repartition(parts), rates)
        rows = placed.collect()
        share = Counter(r.source for r in rows)
        assert all(abs(share[s] / 8_000 - 1 / 3) < 0.03 for s in ("none", "one", "own"))
        assert before in (None, sorted(map(repr, rows)))
        before = sorted(map(repr, rows))
        places = placed.selectExpr("spark_partition_id() AS p", "source").distinct().collect()
        assert sum(r.source == "none" for r in places) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = spark.range(5_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", "'equal' AS text", "'r' AS row", "'k' AS key", "id % 2 AS c0", "1 AS place", "2 AS __id")
    for limit in (mixing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
        rows = mixing.poisson_mix(same, spark.createDataFrame([("s", 5000.0, 2.0)], "key string, mass double, rate double")).collect()
        assert abs(len(rows) - 10_000) < 500 and set(rows[0].asDict()) == {*same.columns, "copy"}
        for half in (0, 1):
            assert sorted(r.copy for r in rows if r.c0 == half) == list(range(1, sum(r.c0 == half for r in rows) + 1))


def test_repeated_rows_match_sql(spark, sf_dir, tmp_path):
    """The SQL on a table with repeated rows and nulls everywhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 30").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "CAST(NULL AS LONG) AS n_chars"))
    odd = odd.unionByName(odd.where("doc_id IS NULL"))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in got.description]
    rows = mixing.op4_poisson_mix(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows))) == sorted(map(repr, got.fetchall()))
