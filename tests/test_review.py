"""The critic, citations and evidence on small tables against plain Python."""

import re

from pyspark.sql import functions as F

from spanloom.operators import critic, evidence


def test_what_is_asked_next(spark):
    rows = [
        (1, "revenue growth figures quarterly outlook", ["revenue", "growth"], [["sales", "margin"], ["sales", "cost"]], [9.0, 8.9, 8.8]),
        (2, "revenue growth", ["revenue", "growth"], [["sales"]], [9.0, 1.0, 1.0]),
        (3, "revenue growth", ["revenue", "growth", "apple"], [None], [5.0, 5.0]),
        (4, "who is that very extraordinarily specific person", None, None, None),
        (5, "of the", None, None, None),
        (6, None, None, None, None),
    ]
    questions = spark.createDataFrame([(i, t) for i, t, *_ in rows], "query long, text string")
    hits = spark.createDataFrame([(i, 10 * i + k, s, k + 1) for i, _, _, _, scores in rows if scores for k, s in enumerate(scores)], "query long, doc long, score double, rank int")
    found = spark.createDataFrame(
        [(10 * i + k, terms if k == 0 else ["zebra"], (keys[k] if keys and k < len(keys) else None)) for i, _, terms, keys, scores in rows if scores for k in range(len(scores))], "doc long, terms array<string>, keywords array<string>"
    )
    judged = critic.assessed(questions, hits, found)
    got = {r.query: r for r in judged.collect()}
    assert (got[1].coverage, got[1].accepted, got[1].missing, got[1].anchors) == (0.4, False, ["figures", "outlook", "quarterly"], ["sales", "margin", "cost"])
    assert (got[2].coverage, got[2].accepted) == (1.0, True) and got[2].margin == round((9 - 1) / 9, 6)
    assert (got[3].coverage, got[3].margin, got[3].accepted) == (1.0, 0.0, False)
    assert [(got[i].coverage, got[i].accepted, got[i].hit) for i in (4, 5, 6)] == [(0.0, False, False)] * 3
    asked = {r.query: r.asked for r in critic.asked_next(judged).collect()}
    assert asked == {1: ["figures outlook quarterly sales margin cost", "figures outlook quarterly"], 3: ["apple growth revenue zebra"], 4: ["very person"]}


def test_rounds_find_more_and_stop_for_covered_questions(spark):
    docs = [(1, "apple banana cherry"), (2, "apple apple date elder fig"), (3, "grape fig fig elder"), (4, None), (5, "")]
    docs += [(i, f"filler words number {i}") for i in range(6, 30)]
    questions = [(100, "apple banana cherry"), (101, "date grape lemon melon fig kiwi plum"), (102, "nowhere present"), (103, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "item_id long, text string")
    log, hits = critic.reviewed(d, q)
    rounds = {(r["query"], r["round"]): r for r in log.collect()}
    assert rounds[100, 1].accepted and (100, 2) not in rounds and not rounds[101, 1].accepted and len(rounds[101, 2].asked) == 2
    assert rounds[101, 2].coverage >= rounds[101, 1].coverage and rounds[103, 1].coverage == 0
    top = {}
    for r in hits.collect():
        top.setdefault(r["query"], []).append(r.doc)
    assert top[100][0] == 1 and {2, 3} <= set(top[101])
    assert critic.reviewed(d, q.limit(0))[0].collect() == []


def test_citations_stand_at_their_sentences(spark):
    text = "One two three. Alpha beta gamma delta! Nothing here at all."
    sentences = re.split(r"(?<=[.!?])\s+", text)
    rows = [(1, 7, 1, 3.0, ["alpha", "beta"], sentences, 100.0, 150.0, text), (2, 8, 1, 2.0, ["x"], ["a b"], 5.0, 6.0, "a b"), (2, 9, 2, 1.0, ["x"], [], 7.0, 8.0, None)]
    hits = spark.createDataFrame(rows, "query long, doc long, rank int, score double, terms array<string>, sentences array<string>, start double, end double, text string")
    got = sorted(map(tuple, evidence.refined_citations(hits).collect()))
    total = sum(map(len, sentences))
    first = next(r for r in got if r[0] == 1 and r[1] == 1)
    assert first[2:6] == (7, round(100 + 50 * len(sentences[0]) / total, 3), round(100 + 50 * (len(sentences[0]) + len(sentences[1])) / total, 3), "Alpha beta gamma delta!")
    assert [(r[1], r[2], r[5], r[7]) for r in got if r[0] == 2] == [(1, 8, "a b", "hit"), (2, 9, "", "hit")]
    assert evidence.refined_citations(hits.limit(0)).collect() == []


def test_numbers_come_from_frames_or_from_one_passage(spark):
    speech = [(1, 1, "v", 40.0, 5, "quarter reached ninety one million."), (1, 2, "v", 20.0, 4, " Q3 was sixty eight million and the fourth "), (1, 3, "w", 0.0, 3, "7 apples"), (2, 1, "v", 0.0, 1, "5 things"), (3, 1, "v", 0.0, 1, None)]
    hits = spark.createDataFrame(speech, "query long, rank int, video string, start double, doc long, text string")
    points = spark.createDataFrame([(2, 0, "Q1", 3.5, "$"), (2, 1, None, None, None), (3, 0, "x", None, None)], "query long, place int, label string, value double, unit string")
    passages = {r["query"]: r.passage for r in evidence.spoken_passages(hits).collect()}
    assert passages == {1: "Q3 was sixty eight million and the fourth quarter reached ninety one million.", 2: "5 things"}
    got = sorted((r["query"], r.value, r.label, r.unit, r.source) for r in evidence.collected(points, hits).collect())
    assert got == [(1, 68e6, "Q3", "", "speech"), (1, 91e6, "Q4", "", "speech"), (2, 3.5, "Q1", "$", "frame")]
    assert evidence.collected(points.limit(0), hits).where(F.col("query") == 2).first().source == "speech"
