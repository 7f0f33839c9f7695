"""BM25: postings, corpus statistics and scored top lists."""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import NUMBER_WORDS, WORD, lexical_tokens
from ..sources import sinks
from ..sources.tables import materialized, spread, tasks

K1 = 1.4
B = 0.72
QUERY_BOOST = 0.15
#: Up to this many distinct query terms, their statistics and the queries' terms are broadcast; beyond, joined by shuffle.
BROADCAST_TERMS = 100_000
#: Up to this many ids of deleted documents are broadcast.
BROADCAST_IDS = 4_000_000
#: Up to this many rows (query, term) top lists are made by matrix products; beyond, by joins.
QUERY_ROWS = 1_000_000
WORDS = re.compile(WORD).findall
#: Texts that are counted at once.
TEXTS = 500
#: Queries of a product, and cells of its matrix of documents and terms.
QUERIES = 256
CELLS = 2_000_000


def repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in several rows."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def tokenized(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """doc, t (its tokens) and others, of every document with a token."""
    small = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), *others), "doc", "text")
    return small.withColumn("t", lexical_tokens(F.col("text"))).drop("text").where(F.size("t") > 0)


def counts_of(text: str) -> tuple[int, dict[str, int]]:
    """How many tokens a text has, as ``lexical_tokens`` gives them, and how often each."""
    found = Counter(WORDS(text.lower()))
    n = found.total()
    for word in NUMBER_WORDS.keys() & found.keys():
        n += found[word]
        found[NUMBER_WORDS[word]] += found[word]
    return n, found


def _bags(words: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps rows (..., text) to (..., len, terms, tfs) for every text with a token: its terms and how often each; of given words only these, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None if words is None else {w: i for i, w in enumerate(words)}
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                keep, lengths, ends, terms, tfs = [], [], [0], [], []
                for i, text in enumerate(batch.column("text")):
                    n, found = counts_of(text.as_py() or "")
                    if n:
                        if places is not None:
                            found = {places[w]: found[w] for w in places.keys() & found.keys()} if len(places) < len(found) else {places[w]: c for w, c in found.items() if w in places}
                        keep.append(i)
                        lengths.append(n)
                        terms += found.keys()
                        tfs += found.values()
                        ends.append(len(terms))
                made = [pa.array(lengths, pa.int32()), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, k)) for x, k in ((terms, pa.string() if words is None else pa.int32()), (tfs, pa.int32())))]
                names = batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in names] + made, names=[*names, "len", "terms", "tfs"])

    return run


def bags(docs: DataFrame, id_col: str, text_col: str, words: list[str] | None = None, **others: Column) -> DataFrame:
    """doc, others (booleans), len, terms, tfs: a row per text with a token, counted within the row; of given words only these, as their places."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = spread(docs.select(F.col(id_col).alias("doc"), *[c.alias(n) for n, c in others.items()], F.col(text_col).alias("text")), "doc", "text")
    return texts.mapInArrow(_bags(words), f"doc {kind}, {''.join(f'{n} boolean, ' for n in others)}len int, terms array<{'string' if words is None else 'int'}>, tfs array<int>")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, term, len, tf: one row per distinct term of a document. Null or wordless texts have no rows.

    Counted within the row, so without a shuffle and with the memory of one text; only where an id stands in several rows, those of the same length are added up.
    """
    each = bags(docs, id_col, text_col).select("doc", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("c"))
    rows = each.select("doc", F.col("c.terms").alias("term"), "len", F.col("c.tfs").cast("long").alias("tf"))
    return rows.groupBy("doc", "term", "len").agg(F.sum("tf").alias("tf")) if repeated(docs, id_col) else rows


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, len of every document with a token."""
    return bags(docs, id_col, text_col, []).select("doc", "len")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query, term, qtf."""
    tokens = queries.select(F.col(id_col).alias("query"), F.explode(lexical_tokens(F.col(text_col))).alias("term"))
    return tokens.groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _bounded_terms(terms: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Distinct query terms, and a broadcast hint for tables of one row per query term where these are few."""
    wanted = terms.select("term").distinct()
    return wanted, F.broadcast if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)


def _scored(tf: DataFrame, terms: DataFrame, stats: DataFrame, total: DataFrame, small: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """query, doc (and keys that hang on it), score from tf (term, doc, len, tf), query terms, stats (term, df) and total (one row: n, avg_len)."""
    total = F.broadcast(total)  # one row
    qidf = idf(F.col("n"), F.col("df")) * (1 + QUERY_BOOST * F.log(F.col("qtf") + 1))
    weighted = terms.join(stats, "term").crossJoin(total).select("query", "term", qidf.alias("w"), "avg_len")
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    pairs = tf.join(small(weighted), "term").select("query", "doc", *keys, (norm * F.col("w")).alias("s"))
    return pairs.groupBy("query", "doc", *keys).agg(F.round(F.sum("s"), 6).alias("score"))


def scores(docs: DataFrame, queries: DataFrame, doc_filter: Column | None = None, doc_id: str = "doc_id", query_id: str = "item_id", keys: Sequence[str] = ()) -> DataFrame:
    """query, doc, score (and ``keys``, columns of ``docs``) for every pair that shares a term, rounded to six places.

    Corpus statistics cover all documents; ``doc_filter`` (over the columns of ``docs``) only limits which are scored.
    Documents are tokenized once: the postings of the query terms are dealt out by document and written aside, and statistics and scores
    are read from there; adding up scores needs no shuffle.
    """
    terms = query_terms(queries, query_id)
    wanted_terms, small = _bounded_terms(terms)
    flag = F.lit(True) if doc_filter is None else F.coalesce(doc_filter, F.lit(False))
    tokens = tokenized(docs, doc_id, "text", flag.alias("wanted"), *map(F.col, keys))
    # every document also has the term '', which counts documents and their lengths
    marked = wanted_terms.unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    hits = tokens.select("doc", "wanted", *keys, F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).join(small(marked), "term", "left_semi")
    # an explicit number keeps small inputs, which grow by the queries of each term, from landing in one task
    hits = hits.repartition(tasks(docs.sparkSession), "doc")
    tf = materialized(hits.groupBy("doc", "wanted", *keys, "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("lens"))
    total = stats.where("term = ''").select(F.col("df").alias("n"), (F.col("lens") / F.col("df")).alias("avg_len"))
    return _scored(tf.where("wanted AND term <> ''"), terms, stats.select("term", "df"), total, small, keys)


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """rank 1..k per query by score, ties by document id."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _held_terms(terms: DataFrame) -> tuple[list, list[str], np.ndarray] | None:
    """Query ids, distinct terms, and rows (query, term, qtf) by their places in both; None where these are too many for the driver."""
    if terms.limit(QUERY_ROWS + 1).count() > QUERY_ROWS or terms.select("term").distinct().limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    rows = terms.select("query", "term", "qtf").collect()
    ids, words = {}, {}
    places = [(ids.setdefault(r.query, len(ids)), words.setdefault(r.term, len(words)), r.qtf) for r in rows]
    return list(ids), list(words), np.array(places, np.int64).reshape(-1, 3)


def _best(words: int, queries: int, places: np.ndarray, weights: np.ndarray, mean: float, k: int, flags: Sequence[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps rows (doc, flags, len or lens, terms, tfs) to the k best (list, q, doc, score) of a task for each flag and query, ties by doc.

    A block of documents by terms times one of terms by queries gives all scores of the block; only the k best so far are kept.
    """

    def merged(held: tuple | None, scores: np.ndarray, docs: np.ndarray) -> tuple | None:
        if held is not None and len(held[0]) == k:
            near = scores >= held[0][-1]
            scores, docs = scores[near], docs[near]
        if not len(scores):
            return held
        if len(scores) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, docs = scores[near], docs[near]
        if held is not None:
            scores, docs = np.concatenate([held[0], scores]), np.concatenate([held[1], docs])
        by_doc = np.argsort(docs, kind="stable")
        order = by_doc[np.argsort(-scores[by_doc], kind="stable")][:k]
        return scores[order], docs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for first in range(0, queries, QUERIES):
            mine = (places[:, 0] >= first) & (places[:, 0] < first + QUERIES)
            used, col = np.unique(places[mine, 1], return_inverse=True)
            w = np.zeros((len(used), min(QUERIES, queries - first)))
            w[col, places[mine, 0] - first] = weights[mine]
            where = np.full(words, -1)
            where[used] = np.arange(len(used))
            parts.append((first, where, w))
        best: dict[tuple, tuple | None] = {}
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            marks = [batch.column(f).to_numpy(zero_copy_only=False).astype(bool) for f in flags]
            count = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(count)])
            at, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            length = batch.column("lens").flatten().to_numpy(zero_copy_only=False) if "lens" in batch.schema.names else np.repeat(batch.column("len").to_numpy(zero_copy_only=False), count)
            norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            row = np.repeat(np.arange(batch.num_rows), count)
            for first, where, w in parts:
                step = max(1, CELLS // max(1, *w.shape))
                for low in range(0, batch.num_rows, step):
                    high = min(low + step, batch.num_rows)
                    part = slice(ends[low], ends[high])
                    col = where[at[part]]
                    seen = col >= 0
                    x = np.zeros((high - low, len(w)))
                    np.add.at(x, (row[part][seen] - low, col[seen]), norm[part][seen])
                    raw = (x @ w).T
                    some = raw > 0
                    scores = np.floor(raw * 1e6 + 0.5) / 1e6
                    for f, mark in enumerate(marks):
                        for q in range(len(raw)):
                            near = some[q] & mark[low:high]
                            best[f, first + q] = merged(best.get((f, first + q)), scores[q][near], docs[low:high][near])
        held = [(f, q, *v) for (f, q), v in best.items() if v is not None]
        if held:
            size = [len(v[2]) for v in held]
            lists, q = (np.repeat(np.array([v[i] for v in held], np.int32), size) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(q), pa.array(np.concatenate([v[3] for v in held]), kind), pa.array(np.concatenate([v[2] for v in held]))], names=["list", "q", "doc", "score"])

    return run


def _top_of(counts: DataFrame, queries: tuple[list, list[str], np.ndarray], kind, df: DataFrame, total: DataFrame, k: int, lists: dict[str, str]) -> DataFrame:
    """query, list, doc, score, rank from counts (doc, a flag per list, len or lens, terms, tfs), names of lists by their flags, df (term by its place, df) and total (one row: n, avg_len)."""
    spark = counts.sparkSession
    ids, words, places = queries
    n, mean = total.select("n", "avg_len").first()
    docs_of = np.ones(len(words))
    for r in df.select("term", "df").collect():  # a row per query term
        docs_of[r.term] = r.df
    weights = np.log(1 + (n - docs_of + 0.5) / (docs_of + 0.5))[places[:, 1]] * (1 + QUERY_BOOST * np.log(places[:, 2] + 1)) if len(places) else np.zeros(0)
    doc = counts.schema["doc"].dataType
    found = counts.mapInArrow(_best(len(words), len(ids), places, weights, mean or 1.0, k, list(lists), to_arrow_type(doc)), f"list int, q int, doc {doc.simpleString()}, score double")
    order = W.partitionBy("list", "q").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query", kind)]))
    names = F.array(*map(F.lit, lists.values()))
    return ranked.join(F.broadcast(named), "q").select("query", F.get(names, F.col("list")).alias("list"), "doc", "score", "rank")


def top_lists(docs: DataFrame, queries: DataFrame, k: int, lists: dict[str, Column], doc_id: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """query, list, doc, score, rank: the k best documents of every query in each list, a condition on the columns of ``docs``; scores and order as ``scores`` and ``top_k`` have them.

    Texts are cut into words once and the counts of the query terms written aside, a row per document. Documents and queries then meet in blocks as matrix products, and a task keeps k rows
    per query, so that pairs are neither joined nor shuffled. Where there are very many query terms, or an id stands in several rows, pairs are joined.
    """
    terms = query_terms(queries, query_id)
    held = _held_terms(terms)
    flags = {name: F.coalesce(c, F.lit(False)) for name, c in lists.items()}
    if held is None or docs.schema[doc_id].dataType.simpleString() not in ("bigint", "int", "string") or repeated(docs, doc_id):
        pairs = scores(docs.withColumn("__lists", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))), queries, doc_id=doc_id, query_id=query_id, keys=("__lists",))
        order = W.partitionBy("query", "list").orderBy(F.desc("score"), "doc")
        return pairs.select("query", F.explode("__lists").alias("list"), "doc", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    marks = [f"__in{i}" for i in range(len(flags))]
    counts = materialized(bags(docs, doc_id, "text", held[1], **dict(zip(marks, flags.values(), strict=True))))
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return _top_of(counts, held, terms.schema["query"].dataType, df, total, k, dict(zip(marks, flags, strict=True)))


def top(docs: DataFrame, queries: DataFrame, k: int = 10, doc_filter: Column | None = None, doc_id: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """query, doc, score, rank: as ``top_k`` of ``scores``."""
    return top_lists(docs, queries, k, {"wanted": F.lit(True) if doc_filter is None else doc_filter}, doc_id, query_id).drop("list")


# An index that is kept: segments of postings and of document lengths, and lists of deleted documents, under one folder.

#: Postings are filed by a hash of their term, so that a search reads the files of its terms' buckets only.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(sinks.read_pointer(spark, path) or '{"segments": [], "gone": []}')


def add_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Index documents as a new segment; the index is made where there is none. Ids that it holds already must be deleted first.

    The segment is complete before the manifest names it: a job that fails or loses executors leaves the index as it was.
    """
    spark = docs.sparkSession
    manifest = _manifest(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    filed = postings(docs, id_col, text_col).withColumn("bucket", _bucket(F.col("term")))
    filed.repartition(tasks(spark), "bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/{name}/postings")
    lengths = doc_lengths(docs, id_col, text_col)
    (lengths.distinct() if repeated(docs, id_col) else lengths).write.parquet(f"{path}/{name}/documents")
    sinks.write_pointer(spark, path, json.dumps({**manifest, "segments": [*manifest["segments"], name]}))


def delete_documents(spark: SparkSession, ids: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Delete documents by id, at the cost of their number: a list is written that hides them in the segments so far."""
    manifest = _manifest(spark, path)
    name = f"gone-{uuid.uuid4().hex}"
    ids.select(F.col(id_col).alias("doc")).distinct().write.parquet(f"{path}/{name}")
    sinks.write_pointer(spark, path, json.dumps({**manifest, "gone": [*manifest["gone"], [name, len(manifest["segments"])]]}))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """postings (term, doc, tf, len, bucket) and documents (doc, len) of the index, without what was deleted."""
    manifest = _manifest(spark, path)
    if not manifest["segments"]:
        raise FileNotFoundError(f"no index at {path}")

    def live(kind: str) -> DataFrame:
        parts = []
        for k, name in enumerate(manifest["segments"]):
            part = spark.read.parquet(f"{path}/{name}/{kind}")
            for gone, until in manifest["gone"]:
                if k < until:
                    hidden = spark.read.parquet(f"{path}/{gone}")
                    part = part.join(F.broadcast(hidden) if hidden.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else hidden, "doc", "left_anti")
            parts.append(part)
        return functools.reduce(DataFrame.unionByName, parts)

    return live("postings"), live("documents")


def compact(spark: SparkSession, path: str) -> None:
    """Write all segments as one without the deleted documents. Old files stay until ``sinks.remove_unnamed`` is called, as readers may hold them."""
    filed, documents = read_index(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    filed.repartition(tasks(spark), "bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/{name}/postings")
    documents.write.parquet(f"{path}/{name}/documents")
    sinks.write_pointer(spark, path, json.dumps({"segments": [name], "gone": []}))


def search_index(spark: SparkSession, path: str, queries: DataFrame, query_id: str = "item_id") -> DataFrame:
    """query, doc, score as ``scores`` gives over the documents of the index, read from the postings of the queries' terms alone."""
    filed, documents = read_index(spark, path)
    terms = query_terms(queries, query_id)
    wanted, small = _bounded_terms(terms)
    # the join on bucket prunes files before the one on term prunes rows
    buckets = [r["b"] for r in wanted.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    hits = filed.where(F.col("bucket").isin(buckets)).join(small(wanted), "term", "left_semi").select("doc", "term", "len", "tf").repartition(tasks(spark), "doc")
    stats = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = documents.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return _scored(hits, terms, stats, total, small)


def search_index_top(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_id: str = "item_id") -> DataFrame:
    """query, doc, score, rank: as ``top_k`` of ``search_index``. A document's postings come together in one row, and pairs are made in blocks as in ``top_lists``."""
    terms = query_terms(queries, query_id)
    held = _held_terms(terms)
    filed, documents = read_index(spark, path)
    if held is None or filed.schema["doc"].dataType.simpleString() not in ("bigint", "int", "string"):
        return top_k(search_index(spark, path, queries, query_id), k)
    places = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(held[1])], "term string, at int"))
    buckets = [r["b"] for r in places.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    hits = filed.where(F.col("bucket").isin(buckets)).join(places, "term").select("doc", "at", F.col("tf").cast("int").alias("tf"), "len")
    rows = hits.repartition(tasks(spark), "doc").groupBy("doc").agg(F.collect_list(F.struct("at", "tf", "len")).alias("p"))
    counts = materialized(rows.select("doc", F.lit(True).alias("__in0"), F.col("p.len").alias("lens"), F.col("p.at").alias("terms"), F.col("p.tf").alias("tfs")))
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = documents.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return _top_of(counts, held, terms.schema["query"].dataType, df, total, k, {"__in0": "wanted"}).drop("list")
