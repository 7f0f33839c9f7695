"""Resolution of questions and planning of tasks against a plain fold over each conversation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import conversation as C
from spanloom.operators import planning

POOL = (
    "what happened right after before then the second one first last final fifth it that they revenue chart diagram kubernetes rollout numbers why and who said more about "
    "next previous architecture let us look at this quarterly latency 2nd Second THAT until since one part"
).split()


def words(text):
    return [w for w in re.findall(r"[a-z0-9][a-z0-9'-]{2,}", text.lower()) if w not in tx.QUESTION_STOP]


def plain_keywords(cites, hits):
    out = []
    for _, _, quote in (cites or [])[:3]:
        subject = [w for w in words(quote or "") if w not in tx.SCAFFOLDING and w not in C.FILLER]
        out += [w for w in subject[:6]]
    out = list(dict.fromkeys(out))
    if len(out) < 3:
        for ks in (hits or [])[:3]:
            out += [k for k in ks[:4] if " " not in k and k not in out]
        out = list(dict.fromkeys(out))
    return out[:8]


def plain_resolve(question, last):
    q = (question or "").strip()
    own = words(q)
    subjects = [w for w in own if w not in tx.SCAFFOLDING]
    order = re.search(tx.ORDER_WORDS, q)
    follows = last is not None and bool(re.search(tx.PRONOUNS, q) or order and len(subjects) <= 1 or not subjects)
    if not follows:
        return q, False, None, None, []
    cites, notes, span = last["cites"] or [], [], None
    place = C.PLACES.get(order[1].lower()) if order else None
    by_time = sorted(cites, key=lambda c: c[0])
    if place is not None and by_time and place < len(by_time):
        start, end, _ = by_time[place]
        span = (max(0.0, start - 5), end + 30)
        notes.append(f'"{order[1]}" resolved to the moment at {start:.0f}s')
    word = re.search(C.TIME_WORDS, q)
    if span is None and word and cites:
        at = cites[0][0]
        if word[1].lower() in C.AFTER_WORDS:
            span = (at, at + 90)
            notes.append(f"limited to the 90s after {at:.0f}s")
        else:
            span = (max(0.0, at - 60), at)
            notes.append(f"limited to the 60s before {at:.0f}s")
        notes.append(f"anchored on the previous answer at {at:.0f}s")
    carried = [k for k in last["keywords"] if k not in own][:4] or [w for w in words(last["question"] or "") if w not in own][:4]
    if carried:
        notes.append("carried forward: " + ", ".join(carried))
    return " ".join([q, *carried]), True, *(span or (None, None)), notes


def made_turns():
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in sorted(rng.sample(range(-3, 40), rng.randint(1, 12))):
            question = None if rng.random() < 0.03 else rng.choice(["", " ", "\t"]) + " ".join(rng.choice(POOL) for _ in range(rng.randint(0, 6))) + rng.choice(["", "?", "\n"])
            cites = None if rng.random() < 0.1 else [(round(rng.uniform(0, 200), 1) if rng.random() < 0.7 else 12.5, 300.0, " ".join(rng.choice(POOL) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
            hits = None if rng.random() < 0.2 else [[rng.choice([*POOL, "two words"]) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 4))]
            rows.append((conv, turn, question, cites, hits))
    return rows


@pytest.mark.parametrize("bucket", [4, C.BUCKET])
def test_resolution_equals_a_fold_over_turns(spark, bucket):
    rows = made_turns()
    df = spark.createDataFrame(rows, f"conv long, turn long, question string, cites {C.CITATIONS}, hits array<array<string>>")
    got = {(r.conv, r.turn): r for r in C.resolve_conversations(df.repartition(5), "conv", "turn", "question", "cites", "hits", bucket).collect()}
    assert len(got) == len(rows)
    last, seen = {}, set()
    for conv, turn, question, cites, hits in rows:
        want = plain_resolve(question, last.get(conv))
        r = got[conv, turn]
        assert (r.query, r.follows, r.range_start, r.range_end, r.notes) == want, (question, last.get(conv))
        assert r.keywords == plain_keywords(cites, hits)
        last[conv] = {"question": question, "cites": cites, "keywords": r.keywords}
        seen |= {n.split(" ")[0] for n in want[4]}
    assert {"limited", "anchored", "carried"} <= seen and '"second"' in seen


def test_questions_that_lean_and_those_that_do_not(spark):
    cites = [(8.5, 12.0, "the architecture diagram appears"), (2.0, 4.0, "welcome everyone")]
    cases = {"what happened right after that?": True, "Tell me more about it": True, "the second one": True, "why?": True, "what about the revenue numbers": False, "summarise the main points": False}
    rows = [x for i, q in enumerate(cases) for x in ((i, 0, "when do they show the architecture diagram?", cites, None), (i, 1, q, None, None))]
    df = spark.createDataFrame(rows, f"conv long, turn long, question string, cites {C.CITATIONS}, hits array<array<string>>")
    got = {r.question: r for r in C.resolve_conversations(df, "conv", "turn", "question", "cites", "hits").where("turn = 1").collect()}
    assert {q: r.follows for q, r in got.items()} == cases
    after = got["what happened right after that?"]
    assert (after.range_start, after.range_end) == (8.5, 98.5) and "architecture" in after.query  # where the answer was, not its earliest citation
    assert got["what about the revenue numbers"].query == "what about the revenue numbers" and not got["what about the revenue numbers"].notes
    second = got["the second one"]
    assert (second.range_start, second.range_end) == (3.5, 42.0)
    assert C.resolve_conversations(df.limit(0), "conv", "turn", "question", "cites", "hits").collect() == []


def test_history_fits_its_budget(spark):
    rng = random.Random(3)
    rows = [(c, t, "q" * rng.randint(0, 200), None if rng.random() < 0.1 else "  " + "a" * rng.randint(0, 500)) for c in range(30) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv long, turn long, q string, a string")
    got = {r.conv: r.context for r in C.history_budget(df, "conv", "turn", "q", "a").collect()}
    for c in range(30):
        lines, used = [], 0
        for _, _, q, a in [r for r in rows if r[0] == c][-3:]:
            entry = f"Q: {q}\nA: {(a or '').strip()[:300]}"
            if used + len(entry) > 900:
                break
            lines.append(entry)
            used += len(entry)
        assert got[c] == "\n\n".join(lines)


def test_tasks_and_what_they_wait_for(spark):
    rows = [(1, "Who said how many users before the chart?"), (2, "give me an overview"), (3, "compute the growth"), (4, None), (5, "compare A versus B on the slide")]
    got = {}
    for r in planning.planned(spark.createDataFrame(rows, "id long, q string"), "id", "q").orderBy("id", "task").collect():
        got.setdefault(r.id, []).append((r.task, r.kind, r.needs, r.level))
    assert got[1] == [("t1", "visual_lookup", [], 0), ("t2", "speaker_attribution", ["t1"], 1), ("t3", "temporal_locate", ["t1"], 1), ("t4", "chart_extraction", ["t1"], 1), ("t5", "computation", ["t1", "t2", "t3", "t4"], 2)]
    assert got[2] == [("t1", "summarize", [], 0)] and got[4] == [("t1", "transcript_lookup", [], 0)]
    assert got[3] == [("t1", "transcript_lookup", [], 0), ("t2", "computation", ["t1"], 1)]
    assert [k for _, k, _, _ in got[5]] == ["visual_lookup", "compare"]
    one = planning.planned(spark.createDataFrame(rows, "id long, q string"), "id", "q").where("id = 1 AND task = 't1'").select("bias", "intent", F.col("bias")["image"].alias("image")).first()
    assert one.image == 1.75 and one.intent.endswith("treated as a visual/temporal/numeric/attribution question")
