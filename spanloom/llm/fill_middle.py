"""Fill-in-the-middle examples, cut by DuckDB inside ``mapInArrow``.

Every Arrow batch is registered with an in-memory DuckDB of the task, whose SQL cuts the texts into
code points (regexp_extract_all), takes the three parts (list_slice, array_to_string), draws places
and forms from sha256 and puts the parts together again; what comes back is Arrow. Python sees batches, never rows.
A text of more than PIECE code points is cut piece by piece, so that the list of its code points is never whole in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_CHARS, bound_batches, table

#: Code points that are cut at once; a list entry takes some 16 bytes, several times over.
PIECE = 500_000
#: Of a hundred documents so many are transformed, and so many of those put the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
#: Before the draws' key in what is hashed.
SALT = "1:"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

#: Draws h1 to h4 are the first four groups of eight hex digits.
PLACES = """
CREATE OR REPLACE TEMP TABLE places AS
WITH hashed AS (SELECT row, text, length(text) AS n, sha256($salt || key) AS h FROM batch),
drawn AS (SELECT row, text, n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT) AS d FROM hashed)
SELECT row, text, n::BIGINT AS n, least(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS a, greatest(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS b,
    CASE WHEN n = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR d[3] % 100 >= $transformed THEN 'plain'
         WHEN d[4] % 100 < $suffix_first THEN 'spm' ELSE 'psm' END AS form
FROM drawn
"""
#: The parts of a piece: code points up to a, from a to b, after b, counted within it.
CUT = """
INSERT INTO parts
WITH pieces AS (
    SELECT row, greatest(a - $start, 0) AS a, greatest(b - $start, 0) AS b, regexp_extract_all(CASE WHEN n <= $size THEN text ELSE substring(text, $start + 1, $size) END, '(?s).') AS u
    FROM places WHERE form <> 'plain' AND n > $start)
SELECT row, $start, array_to_string(list_slice(u, 1, a), ''), array_to_string(list_slice(u, a + 1, b), ''), array_to_string(list_slice(u, b + 1, $size), '') FROM pieces
"""
JOINED = """
WITH whole AS (SELECT row, string_agg(prefix, '' ORDER BY piece) AS prefix, string_agg(middle, '' ORDER BY piece) AS middle, string_agg(suffix, '' ORDER BY piece) AS suffix FROM parts GROUP BY row)
SELECT n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM places LEFT JOIN whole USING (row) ORDER BY row
"""
RESTORED = """
SELECT CASE form
    WHEN 'psm' THEN split_part(split_part(output, $s, 1), $p, 2) || split_part(output, $m, 2) || split_part(split_part(output, $s, 2), $m, 1)
    WHEN 'spm' THEN split_part(split_part(output, $p, 2), $m, 1) || split_part(output, $m, 2) || split_part(split_part(output, $p, 1), $s, 2)
    ELSE output END AS restored
FROM batch ORDER BY row
"""


def connection():
    """A DuckDB in the memory of this task, with one thread, no folder of its own and no downloads."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})


def stretches(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts with about ``limit`` code points; a longer one stands alone or ends them."""
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    start, n = 0, len(texts)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, stop
        start = stop


def map_sql(df: DataFrame, columns: Sequence[Column], fields: T.StructType, keep: Sequence[str], make: Callable[[], Callable[[pa.Table], pa.Table]]) -> DataFrame:
    """``keep`` and what DuckDB makes of the string ``columns``, the first of which sets how many rows go at once."""
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    n, inner = len(keep), [f"__{i}" for i in range(len(columns))]
    source = df.select(*[df[c] for c in keep], *[c.alias(i) for c, i in zip(columns, inner, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            given = [pc.fill_null(batch.column(n + i).cast(pa.large_string()), "") for i in range(len(inner))]
            for start, stop in stretches(given[0]):
                part = [c.slice(start, stop - start) for c in given]
                got = fn(pa.table([pa.array(np.arange(stop - start)), *part], names=["row", *inner]))
                kept = [batch.column(i).slice(start, stop - start) for i in range(n)]
                made = [got.column(f.name).combine_chunks().cast(t) for f, t in zip(fields, types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
    return source.mapInArrow(run, schema)


CUT_FIELDS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    salt: str = SALT,
    marks: tuple[str, str, str] = MARKS,
    piece: int = PIECE,
) -> DataFrame:
    """``n, form, prefix_chars, middle_chars, output`` of every whole text, in one narrow pass.

    Two draws, hashed from the id, cut a text after any numbers of its code points. ``form`` is psm (prefix, suffix, middle),
    spm (suffix, prefix, middle) or plain: the text as it is, without lengths of parts. Empty texts, those that hold a mark and
    those drawn to stay are plain. Null texts count as empty, null ids as the empty key; rows of the same id and text
    give equal rows. Columns in ``keep`` pass unless a result has their name; others are not read. An empty table gives an empty one.
    """
    p, s, m = marks
    if len({p, s, m}) < 3 or not all(len(x) > 2 and x[0] == "<" and x[-1] == ">" and not set("<>") & set(x[1:-1]) for x in marks):
        raise ValueError("marks are three different names in angle brackets")

    def make() -> Callable[[pa.Table], pa.Table]:
        con = connection()
        con.execute("CREATE TEMP TABLE parts (row BIGINT, piece BIGINT, prefix VARCHAR, middle VARCHAR, suffix VARCHAR)")
        named = {"p": p, "s": s, "m": m}

        def run(batch: pa.Table) -> pa.Table:
            con.register("batch", batch.rename_columns(["row", "text", "key"]))
            con.execute(PLACES, {"salt": salt, "transformed": transformed, "suffix_first": suffix_first, **named})
            con.execute("TRUNCATE parts")
            longest = con.execute("SELECT max(n) FROM places WHERE form <> 'plain'").fetchone()[0] or 0
            for start in range(0, longest, piece):
                con.execute(CUT, {"start": start, "size": piece})
            return con.execute(JOINED, named).to_arrow_table()

        return run

    return map_sql(df, [F.col(text_col).cast("string"), F.col(id_col).cast("string")], CUT_FIELDS, keep, make)


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output", keep: Sequence[str] = ("doc_id",), marks: tuple[str, str, str] = MARKS, out: str = "restored") -> DataFrame:
    """The inverse: the text that ``output_col`` was made of, told from it and its form alone. A mark stands once in it, as only texts without marks are cut."""
    p, s, m = marks

    def make() -> Callable[[pa.Table], pa.Table]:
        con = connection()

        def run(batch: pa.Table) -> pa.Table:
            con.register("batch", batch.rename_columns(["row", "output", "form"]))
            return con.execute(RESTORED, {"p": p, "s": s, "m": m}).to_arrow_table().rename_columns([out])

        return run

    return map_sql(df, [F.col(output_col).cast("string"), F.col(form_col).cast("string")], T.StructType([T.StructField(out, T.StringType())]), keep, make)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all ``documents`` with digests of the output and of the text restored from it; nulls, empty and long texts as in fill_in_middle."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    restored = restore(made.withColumn("output_sha256", F.sha2("output", 256)), keep=kept)
    return restored.select(*kept, F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": SQL}
