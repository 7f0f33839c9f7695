import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe, token_counts

PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'ll", "'re", "'", "!", "é", "ß", "1", "23", "中", "文", "😀", "\xa0", "<|endoftext|>", "<|endof", "text|>", "''", "S", "\t", "\x1c", "²", "é"]


@pytest.fixture(scope="module")
def tiny():
    return bpe.TreeEncoder(bpe.default_vocabulary(), leaf_chars=5, window=1)


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_tree_equals_whole_on_hard_mixtures(tiny):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES[: rng.randint(2, len(PIECES))]) for _ in range(rng.randint(0, 40)))
        ids = tiny.encode([text])[0]
        assert ids == whole(tiny, text), text
        assert tiny.decode([ids]) == [text] == [tiny.tokenizer.decode(ids, skip_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_tree_equals_whole_on_any_text(text):
    encoder = bpe.worker_encoder(None, 7, 1)
    assert encoder.encode([text])[0] == whole(encoder, text)


@pytest.mark.parametrize("unit", ["a", "thntionedwh", "!", "   ", "'s", "9", "é", "ab1"])
def test_very_long_unsplit_text(unit):
    encoder = bpe.worker_encoder(None)
    text = unit * (60_000 // len(unit))
    assert encoder.encode([text])[0] == whole(encoder, text)


def test_documents(spark):
    texts = [(1, "the cat <|endoftext|> sat"), (2, None), (3, ""), (1, "the cat <|endoftext|> sat"), (None, "x " * 30_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("x", "y")
    df = df.selectExpr("*", "'clash' AS n_tokens", "1 AS other")
    got = bpe.digest_documents(df, keep=("doc_id", "n_tokens")).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    encoder = bpe.worker_encoder(None)
    for (doc, text), row in zip(texts, got, strict=True):
        ids = whole(encoder, text or "")
        assert (row.doc_id, row.n_tokens) == (doc, len(ids))
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_documents(df.drop("n_tokens"))).collect()
    assert [(r.doc_id, r.text) for r in back] == [(d, t or "") for d, t in texts]
    assert bpe.digest_documents(df.limit(0)).count() == 0


def test_histogram_answers(spark):
    lengths = [0, 0, 3, 3, 3, 10, 2000, 5000, None]
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long")))
    known = [x for x in lengths if x is not None]
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(known)
    for limit, r in rows.items():
        assert r.n_docs == known.count(limit)
        assert r.docs_at_least == sum(x >= limit for x in known)
        assert r.docs_at_most == sum(x <= limit for x in known)
        assert r.tokens_at_least == sum(x for x in known if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in known)
        assert r.lost_total == sum(known) - r.truncated_total
    for limit in (1, 3, 11, 4999, 9000):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in known)
    assert token_counts.quantile(sums, 0.5) == 3 and token_counts.quantile(sums, 1.0) == 5000
    empty = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([], "n_tokens long")))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5) is None and token_counts.truncated_total(empty, 5) == 0


def test_histogram_of_documents(spark, sf_dir):
    sums = token_counts.op3_token_histogram(spark, sf_dir)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encoder = bpe.worker_encoder(None)
    known = [len(whole(encoder, t or "")) for t in texts]
    assert {r.n_tokens: (r.n_docs, r.truncated_total) for r in sums.collect()} == {n: (known.count(n), sum(min(x, n) for x in known)) for n in set(known)}


def test_quantiles_and_limits(spark):
    """Against a sorted list for many shares and sizes, and against direct sums for every limit."""
    import random
    from decimal import Decimal
    from fractions import Fraction

    rng = random.Random(4)
    for n in (1, 2, 7, 99, 100):
        known = sorted(rng.choice((k + 1, rng.randint(0, 50))) for k in range(n)) if n != 100 else list(range(1, 101))
        lengths = spark.createDataFrame([(x, "own", 1) for x in known], "n_tokens long, n_docs string, block int")
        sums = token_counts.suffix_sums(token_counts.histogram(lengths)).cache()
        shares = [f"{k / 200:.3f}" for k in range(201)] + ["0.0000000001", Decimal("0.333333333333333333333"), 0.07, 0.55]
        got = {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()}
        for q in shares:
            assert got[str(q)] == known[max(0, -(-Fraction(str(q)) * n // 1) - 1)], (n, q)
        limits = [*range(0, 120, 7), 10**9]
        rows = {r.limit: r for r in token_counts.at_limits(sums, limits).collect()}
        assert len(rows) == len(limits)
        for limit, r in rows.items():
            at = [x for x in known if x >= limit]
            kept = sum(min(x, limit) for x in known)
            assert (r.docs_at_least, r.tokens_at_least, r.truncated_total, r.lost_total) == (len(at), sum(at), kept, sum(known) - kept)
        sums.unpersist()
    assert token_counts.quantile(token_counts.suffix_sums(token_counts.histogram(lengths.limit(0))), 0.5) is None


def test_white_space_runs_and_threads(monkeypatch):
    """Cuts within runs of white space, tiny leaves, and leaves encoded by threads: always the ids of the whole text."""
    import random

    rng = random.Random(3)
    path = bpe.default_vocabulary()
    signs = ["\n", " ", "  ", "\t", "\r\n", "\u3000", "\xa0", " " * 17] * 3 + ["a", "word", "é", "1", "'s", "'ll", "...", "<|endoftext|>", "漢字"]
    tiny = [bpe.TreeEncoder(path, leaf, window) for leaf, window in ((3, 1), (5, 1), (7, 2))]
    for k in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        assert tiny[k % 3].encode([text])[0] == tiny[0].tokenizer.encode(text, add_special_tokens=False).ids, text
    # a window within a long run settles at once
    encoder = bpe.TreeEncoder(path, 1000)
    assert encoder.encode([" " * 50_000])[0] == encoder.tokenizer.encode(" " * 50_000, add_special_tokens=False).ids and encoder.windows < 200
    monkeypatch.setattr(bpe, "PARALLEL_CHARS", 1000)
    text = " ".join(rng.choice(("some", "words", "123", "\n\n", "é")) for _ in range(20_000))
    assert encoder.encode([text, "", text[:50]]) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text[:50])] and encoder.pool is not None
