"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest

from spanloom.llm import fill_middle


def plain(key, text, transformed=90, suffix_first=20):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= transformed:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rng = random.Random(2)
    letters = ["a", "é", "\U0001f600", "\n", "\r\n", "\x00", "́", "<", "P>", "<S", "<M", ">", " ", "\t", "中", '"', "'", "\\", "\x85"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "some text"), (None, None), (-5, "negative"), (7, "x"), (7, "x"), (1 << 62, "large"), (1002, "has <M> in it"), (1003, "a" * 3000 + "é")]
    return rows


@pytest.mark.parametrize("piece", [7, fill_middle.PIECE])
def test_odd_rows_in_any_pieces(spark, piece):
    rows = odd_rows()
    given = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS output", "1 AS `row`", "2 AS n", "3 AS other")
    made = fill_middle.fill_in_middle(given, keep=("doc_id", "text", "output", "row", "n", "other"), piece=piece)
    assert made.columns == ["doc_id", "text", "row", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(repr((i, t, *plain(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.row == 1 and r.other == 3 for r in got)
    back = fill_middle.restore(made, keep=("doc_id", "text")).collect()
    assert len(back) == len(rows) and all(r.restored == (r.text or "") for r in back)


def test_parameters_and_empty_tables(spark):
    rows = [(i, f"text number {i}") for i in range(200)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.fill_in_middle(given, transformed=100, suffix_first=0, marks=("<PRE>", "<SUF>", "<MID>")).collect()
    assert all(r.form == "psm" and r.output.startswith("<PRE>") for r in got)
    assert {r.form for r in fill_middle.fill_in_middle(given, transformed=0).collect()} == {"plain"}
    assert fill_middle.fill_in_middle(given.limit(0)).collect() == [] and fill_middle.restore(fill_middle.fill_in_middle(given.limit(0))).collect() == []
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(given, marks=("<P>", "<P>", "<M>"))


def test_query_equals_plain_python_and_sql(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [tuple(r) for r in fill_middle.op11_fill_in_middle(spark, sf_dir).collect()]
    want = [(i, *plain(i, t)[:4], digest(plain(i, t)[4]), digest(t or "")) for i, t in docs.items()]
    assert sorted(got) == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(fill_middle.ORACLES["op11_fill_in_middle"]).fetchall()) == sorted(got)


def test_one_very_long_text(spark):
    text = "".join(chr(97 + zlib.crc32(str(i).encode()) % 26) + "é" for i in range(900_000))
    given = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(given).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, text)
