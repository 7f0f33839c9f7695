import hashlib
from collections import Counter

import corpus_pipeline
from spanloom.llm import bpe, classifier, mixing, pii, simhash


def test_stages_against_plain_forms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "personal data", "poisson mixing", "bpe encoding"]

    scorer = classifier.Scorer(classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = [r for r in rows if scorer.score(r.text or "") >= 0.5]
    one = corpus_pipeline.quality(spark, docs, sf_dir)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in kept)

    prints = {r.doc_id: simhash.fingerprint(r.text or "") for r in kept}
    classes = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and classes[a] is not classes[b]:
                classes[a] |= classes[b]
                for i in classes[b]:
                    classes[i] = classes[a]
    kept = [r for r in kept if min(classes[r.doc_id]) == r.doc_id]
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(r.doc_id for r in kept)

    weights = pii.trained_weights()
    clean = {r.doc_id: pii.redacted(r.text, pii.all_spans(r.text, weights)[1]) for r in kept}
    three = corpus_pipeline.personal_data(spark, two, sf_dir)
    assert three.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {i: (t, len(t)) for i, t in clean.items()}

    four = corpus_pipeline.mixture(spark, three, sf_dir)
    assert four.columns == docs.columns
    counts = Counter(r.doc_id for r in mixing.poisson_mix(three, mixing.source_rates(three)).select("doc_id").collect())
    assert Counter(r.doc_id for r in four.collect()) == counts and set(counts) <= set(clean)

    encoder = bpe.worker_encoder(None)
    result = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in result) == counts
    for r in result:
        ids = encoder.tokenizer.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_clashing_columns(spark, sf_dir):
    rows = [(1, None, None, None, None, 0.1, 7), (2, "", "en", "a", 0, 0.2, 8), (2, "", "en", "a", 0, 0.2, 8), (None, "some words are here now mail a@b.co", "en", None, 5, 0.3, 9), (5, "same text again and again 4929963689861572", None, "hot", None, None, None), (6, "same text again and again 4929963689861572", "en", "hot", 1, 0.4, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, copy int").selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, sf_dir)
            assert given.columns == docs.columns
            kept = {(r.doc_id, r.score, r.copy) for r in given.collect()}
            assert kept <= {(r[0], r[5], r[6]) for r in rows}
        assert corpus_pipeline.encoding(spark, given, sf_dir).count() == given.count()
    two = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in two.collect()) == ["1", "5", "None"]
    three = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs, sf_dir).collect()}
    assert three[1] == (None, None) and three[None][0].endswith("mail [EMAIL]") and three[5][1] == len(three[5][0])
