"""Composites against golden answers, plain forms and attack tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import programs
from spanloom.operators import assembly as asm


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_chunks_are_contiguous_and_hold_all_text(spark):
    rows = [(1, i, 5.0 * i, 5.0 * i + 4.5, "a" if i < 6 else "b", f"Words of part {i}.") for i in range(16)] + [(2, 0, 0.0, 3.0, None, "Short")]
    s = spark.createDataFrame(rows, "video_id int, idx int, start double, end double, speaker string, text string")
    scenes = spark.createDataFrame([(1, 0.0), (1, 40.0)], "video_id int, start double")
    spans = asm.chunk_spans(s, scenes)
    got = sorted((r.video_id, r.idx, r.start, r.end) for r in spans.collect())
    first = [g for g in got if g[0] == 1]
    assert first[0][2] == 0.0 and first[-1][3] == 79.5 and all(a[3] == b[2] for a, b in zip(first, first[1:]))
    assert {30.0, 40.0} & {g[2] for g in first}  # the change of speaker or of scene
    chunks = asm.chunk_contents(spans, s).collect()
    assert all(any(f"part {i}." in c.text for c in chunks) for i in range(16))
    assert next(c for c in chunks if c.video_id == 2).speakers == [] and all(c.words_per_s >= 0 for c in chunks)
    assert asm.chunk_spans(s.limit(0), scenes.limit(0)).count() == 0


def test_chapters(spark):
    gaps = spark.createDataFrame([("v", g, g in (0, 2, 3, 8)) for g in range(9)], "g string, gap int, picked boolean")
    cuts = asm.accepted_cuts(gaps, "g", "gap", "picked")
    assert sorted(r.gap for r in cuts.collect()) == [2]
    rows = spark.createDataFrame([("v", i) for i in range(10)], "g string, idx int")
    assert [r.chapter for r in asm.chapters_of(rows, cuts, "g", "idx", "gap").orderBy("idx").collect()] == [0] * 3 + [1] * 7


def test_context_budget_against_a_loop(spark):
    texts = ["x" * n for n in (9000, 100, 3000, 7000, 50, 20_000)]
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "query int, rank int, text string")
    got = asm.filled_context(df, 2600).first().bodies
    left, want = 2600, []
    for t in texts:
        if left <= 0:
            break
        want.append(t[: max(280, int(left * 0.45)) * 4])
        left -= len(want[-1]) // 4 + 40
    assert got == want


def test_sentences_golden(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, ["revenue", "grew"], ["Revenue grew fast.", "Too short", "Nothing to see here."]), (1, "b", 2, ["revenue", "grew"], ["revenue  grew fast.", "Revenue was flat then."])],
        "query int, doc string, rank int, terms array<string>, sentences array<string>",
    )
    rows = asm.ranked_sentences(df, "terms", "sentences").orderBy("place").collect()
    assert [(r.doc, r.sentence) for r in rows] == [("a", "Revenue grew fast."), ("b", "Revenue was flat then."), ("a", "Nothing to see here.")]
    assert rows[0].score == round(0.25 + 2 / np.sqrt(3), 6)


def test_expressions(spark):
    assert one(spark, asm.candidate_times(F.lit(0.0), F.lit(10.0), F.lit(1))) == pytest.approx([0.35, 5.0, 9.65])
    assert one(spark, asm.candidate_times(F.lit(1.0), F.lit(1.1), F.lit(3))) == pytest.approx([1.05])
    assert one(spark, asm.interval_iou(*map(F.lit, (0.0, 4.0, 2.0, 6.0)))) == pytest.approx(1 / 3)
    full = [F.lit(x) for x in (1.0, 0.2, 4, 9, True, True, True)]
    assert one(spark, asm.evidence_confidence(*full)) == 0.97
    assert one(spark, asm.evidence_confidence(F.lit(0.5), F.lit(None).cast("double"), F.lit(1), F.lit(1), F.lit(False), F.lit(False), F.lit(False))) == pytest.approx((0.34 + 0.075 + 0.04) * 0.85, abs=1e-4)
    assert one(spark, asm.visual_description(F.lit(1), F.lit(3), F.lit(0.01), F.lit(1.0))) == "slide or diagram on screen"
    assert one(spark, asm.visual_description(F.lit(0), F.lit(3), F.lit(0.01), F.lit(6.5))) == "detailed camera shot"
    assert [one(spark, asm.human_bytes(F.lit(n))) for n in (0, 512, 2048, 150 * 1024, 5 << 30)] == ["-", "512 B", "2.0 KB", "150 KB", "5.0 GB"]
    assert one(spark, asm.time_filter(F.lit("since 1:02:03")))["start"] == 3723.0 and one(spark, asm.time_filter(F.lit("soon"))) is None
    names = F.array(F.lit("Cy"), F.lit("Ann"))
    assert one(spark, asm.ordinal_speaker(F.lit("the final speaker"), names)) == "Cy" and one(spark, asm.ordinal_speaker(F.lit("the fifth person"), names)) is None


def test_programs(spark):
    df = spark.createDataFrame([(2.0, 8.0)], "a double, b double")
    assert df.select(programs.program("sqrt(a * b) + greatest(a, 1)", df.columns).alias("x")).first().x == 6.0
    assert df.select(programs.program("case when a < b then 'less' else 'more' end", df.columns).alias("x")).first().x == "less"
    attacks = ("", "reflect('java.lang.System', 'exit', 0)", "java_method('x', 'y')", "a; drop table t", "(select 1)", "input_file_name()", "a -- b", "`a`", "secret", "a /* x */", "x" * 3000, "read_files('/etc/passwd')", "a || b", "$x", "current_user()")
    for bad in attacks:
        with pytest.raises(ValueError):
            programs.program(bad, df.columns)


def test_sketches(spark):
    a, b, c = (programs.sketch(t) for t in ("the revenue chart grew", "revenue chart growth", "cats on a mat"))
    assert np.linalg.norm(a) == pytest.approx(1) and a @ b > a @ c and not programs.sketch("").any()
    df = spark.createDataFrame([("revenue chart",), (None,)], "t string")
    rows = df.select(programs.sketch_column(F.col("t")).alias("v")).collect()
    assert len(rows[0].v) == 384 and not any(rows[1].v)


def test_merging(spark):
    from spanloom.operators import merging as mg

    df = spark.createDataFrame([(1, 2, ["b"], {"x": 5}, None), (1, 1, ["a"], {"x": 1, "y": 2}, "p"), (2, 1, None, None, None)], "g int, o int, a array<string>, m map<string,int>, r string")
    rows = {r.g: r for r in mg.folded_state(df, "g", "o", "a", "m", "r").collect()}
    assert (rows[1].a, rows[1].m, rows[1].r) == (["a", "b"], {"x": 5, "y": 2}, "p") and (rows[2].a, rows[2].m, rows[2].r) == ([], {}, None)
    assert one(spark, mg.time_marks(F.lit("at [01:05] and [1:00:00], not [1]"))) == [65, 3600]
    cases = {'```json\n{"a": [1, 2,],}\n```': '{"a": [1, 2]}', "so: {“a”: 1} ok": '{"a": 1}', "[1, 2] tail": "[1, 2]", "none": None, None: None, "{broken": None}
    assert [mg.recovered_json(k) for k in cases] == list(cases.values())
    texts = spark.createDataFrame([(1, "one two"), (2, None)], "g int, t string")
    words = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "g int, w string")
    assert sorted((r.g, r.title) for r in mg.titles(words, "g", "w", texts, "t").collect()) == [(1, "b, a"), (2, "Untitled section")]
    assert sorted((r.g, r.title) for r in mg.titles(words.limit(0), "g", "w", texts, "t").collect()) == [(1, "one two"), (2, "Untitled section")]
