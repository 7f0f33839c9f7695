import re

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash
from spanloom.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(fps, ids, bits=4):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits):
            a, b = sorted((find(i), find(int(j))), key=lambda k: ids[k])
            parent[b] = a
    return [ids[find(i)] for i in range(len(fps))]


def test_fingerprint():
    for text in ["", " \t", "one", "One two THREE", "a b c d e f g", "É x\xa0y z " * 50, "w " * 70_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [plain_fingerprint(r.text) for r in docs]
    component = classes(want, [r.doc_id for r in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_pivots(spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{w:016x}", c) for r, w, c in zip(docs, want, component, strict=True)}
    assert len(set(component)) < len(component)


@pytest.mark.parametrize("section", [4096, 40])
def test_crowded_buckets(spark, section):
    """A crowd within a few bits of one centre, chains, and strangers; also when buckets are dealt out in sections."""
    rng = np.random.default_rng(1)
    fps = list(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    centre = int(fps[0])
    for _ in range(300):
        fps.append(np.uint64(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))))
    chain = int(fps[5])
    for k in range(0, 60, 4):
        chain ^= 0b1111 << k
        fps.append(np.uint64(chain))
    fps = sorted(set(map(int, fps)))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.hamming_edges(df, section=section)).collect()}
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = classes(fps, [simhash._signed(f) for f in fps])
    assert got == want


def test_masks_cover_all_links():
    rng = np.random.default_rng(2)
    for n in (1, 10**6, 10**9, 10**12):
        masks = np.array(simhash.masks(n), np.int64).view(np.uint64)
        for _ in range(200):
            diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
            assert (masks & diff == 0).any()


def test_shuffled_removal_equals_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == want


def test_degenerate(spark):
    rows = [(5, None), (3, ""), (7, "same words here again now"), (2, "same words here again now"), (None, "same words here again now"), (2, "same words here again now"), (9, "quite another text of several words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicate_classes(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("7", 2), ("2", 2), ("None", 2), ("2", 2), ("9", 9)])
    kept = simhash.deduplicate(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "9", "None"] and kept.columns == df.columns
    assert simhash.near_duplicate_classes(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7}
    path = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    assert {r.root for r in connected_components(path).collect()} == {0}


def test_hot_fingerprints(spark, monkeypatch):
    """Rows of a fingerprint that very many share get the same class by the other way."""
    df = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'one two three four five' ELSE concat('some words of ', id) END AS text")
    plain = sorted(map(tuple, simhash.near_duplicate_classes(df).collect()))
    for hot in (0, 50):
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        assert sorted(map(tuple, simhash.near_duplicate_classes(df).collect())) == plain
