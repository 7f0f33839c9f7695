"""SimHash near-duplicates by pivot distance tables.

Fingerprints within ``max_bits`` bits agree on all but ``max_bits`` of any blocks that the 64 bits
are cut into; rows that share enough blocks meet in a bucket, and nothing else can link. In a bucket, a
table holds each fingerprint's Hamming distances to many reference fingerprints (pivots). By the
triangle inequality two fingerprints whose distances to some pivot differ by more than ``max_bits``
are no link: such pairs are discarded by their largest coordinate difference, survivors are
verified bit by bit. Buckets give spanning edges, not pairs, and large buckets are dealt out as
pairs of bounded sections, so that no task gets an unbounded group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_text, table
from .components import connected_components

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Reference fingerprints of the distance tables.
PIVOTS = 16
#: Fingerprints of a bucket beyond this many are dealt out as pairs of sections of about this size.
SECTION = 4096
#: Buckets are made finer until about this many fingerprints share one by chance.
BUCKET = 64
#: Rows that a task gathers before it searches; only a group of two sections can exceed it.
GATHER = 50_000


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed random words, so that every task has the same table."""
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 without words."""
    from xxhash import xxh64_intdigest as digest

    found = text.encode().lower().split()  # bytes: A-Z only, and exactly the white space 20, 09-0D
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return digest(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``fp long`` (the 64 bits as a signed number) of every whole text; null texts count as empty and get 0."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_text(df, make, T.StructType([T.StructField("fp", T.LongType())]), text_col, keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of which any two fingerprints within ``max_bits`` agree on at least one.

    64 bits are cut into ``max_bits + k`` blocks, a mask has k of them; k grows with the number of fingerprints.
    """
    for k in range(1, 6):
        blocks = max_bits + k
        if n / (1 << (64 * k // blocks)) <= BUCKET:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [_signed(sum(c)) for c in itertools.combinations(parts, k)]


def _small_runs(fp: np.ndarray, run: np.ndarray, dist: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within short runs: each row against the next, the next but one, and so on."""
    left, right = [], []
    for s in range(1, len(fp)):
        i = np.flatnonzero(run[:-s] == run[s:])
        if not len(i):
            break
        for p in range(dist.shape[1]):
            i = i[np.abs(dist[i, p] - dist[i + s, p]) <= max_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= max_bits]
        left.append(i)
        right.append(i + s)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _large_run(fp: np.ndarray, dist: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of one long run: breadth first, each row searched once among rows not yet reached."""
    order = np.argsort(dist[:, 0], kind="stable")
    fp, dist = fp[order], dist[order]
    open_rows, left, right = np.ones(len(fp), bool), [], []
    first = dist[:, 0]
    for start in range(len(fp)):
        if not open_rows[start]:
            continue
        open_rows[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            a, b = np.searchsorted(first, [first[u] - max_bits, first[u] + max_bits + 1])
            near = a + np.flatnonzero(open_rows[a:b])
            for p in range(1, dist.shape[1]):
                near = near[np.abs(dist[near, p] - dist[u, p]) <= max_bits]
            near = near[np.bitwise_count(fp[near] ^ fp[u]) <= max_bits]
            if len(near):
                open_rows[near] = False
                left.append(np.full(len(near), order[u]))
                right.append(order[near])
                queue += near.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def run_links(fp: np.ndarray, run: np.ndarray, max_bits: int = MAX_BITS, long_run: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as row numbers) that connect, within each run of equal ``run``, what Hamming links connect."""
    dist = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    small = np.repeat(sizes <= long_run, sizes)
    rows = np.flatnonzero(small)
    a, b = _small_runs(fp[rows], run[rows], dist[rows], max_bits)
    left, right = [rows[a]], [rows[b]]
    for s, n in zip(starts[sizes > long_run], sizes[sizes > long_run], strict=True):
        a, b = _large_run(fp[s : s + n], dist[s : s + n], max_bits)
        left.append(s + a)
        right.append(s + b)
    return np.concatenate(left), np.concatenate(right)


#: Fingerprints of more rows than this are told their class by a broadcast.
HOT_ROWS = 1_000_000
#: Up to this many removed ids (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
EDGES = "u long, v long"


def _search(max_bits: int):
    """Maps batches sorted by bucket to edges; a bucket that a batch cuts is carried over to the next."""
    names = ["m", "k", "p", "q"]

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        fp = cols[0].view(np.uint64)
        change = np.zeros(len(fp), bool)
        for c in cols[1:]:
            change[1:] |= c[1:] != c[:-1]
        a, b = run_links(fp, np.cumsum(change), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(cols[0][a]), pa.array(cols[0][b])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", *names)])
            rows += batch.num_rows
            if rows < GATHER:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.ones(rows, bool)
            for c in cols[1:]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield edges([c[:cut] for c in cols])
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if rows:
            yield edges([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def hamming_edges(fps: DataFrame, max_bits: int = MAX_BITS, section: int = SECTION) -> DataFrame:
    """Edges u, v that connect what links of at most ``max_bits`` bits connect, over distinct ``fp``.

    ``fps`` should be cheap to read again, for instance a checkpoint. Nulls are not linked.
    """
    spark = fps.sparkSession
    fps = fps.where("fp is not null").select("fp").distinct()
    n = fps.count()
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(n, max_bits))])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.m", "x.k")
    crowded = checkpointed(rows.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > section))
    few = crowded.limit(100_001).count()
    if few:
        sections = F.ceil(F.coalesce("n", F.lit(1)) / section).cast("int")
        rows = rows.join(F.broadcast(crowded) if few <= 100_000 else crowded, ["m", "k"], "left")
        rows = rows.select("fp", "m", "k", sections.alias("s")).withColumn("r", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        rows = rows.select("fp", "m", "k", F.least("r", "o").alias("p"), F.greatest("r", "o").alias("q"))
    else:
        rows = rows.select("fp", "m", "k", F.lit(0).alias("p"), F.lit(0).alias("q"))
    dealt = rows.repartition("m", "k", "p", "q").sortWithinPartitions("m", "k", "p", "q")
    return dealt.mapInArrow(_search(max_bits), EDGES)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: id, ``fp long``, ``component_id`` (the least id reachable by links, itself included).

    Exact copies share a fingerprint and are one node. Texts without words have fingerprint 0 and
    link like any other. Repeated rows stay; null ids keep their row and take the least id that is not null of
    their component, or null. Other columns of ``docs`` are not read.
    """
    prints = checkpointed(fingerprints(docs, text_col, (id_col,)).withColumnRenamed(id_col, "id"))
    groups = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = checkpointed(connected_components(hamming_edges(prints, max_bits)))
    joined = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", "n", "root")
    least = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = joined.where("root is not null or n > 1").join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    # a fingerprint of very many rows (empty texts, mass copies) is no shuffle key: there are few such, so they are broadcast
    hot = groups.where(F.col("n") > HOT_ROWS).select("fp")
    heavy = hot.count()
    if heavy:
        known = named.join(hot, "fp", "left_semi")
        if heavy <= BROADCAST_IDS:
            hot, known = F.broadcast(hot), F.broadcast(known)
        found = prints.join(hot, "fp", "left_semi").join(known, "fp", "left").unionByName(prints.join(hot, "fp", "left_anti").join(named, "fp", "left"))
    else:
        found = prints.join(named, "fp", "left")
    return found.select(F.col("id").alias(id_col), "fp", F.coalesce("component_id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The row of the least id of each near-duplicate class, with all its columns.

    Of repeated rows with that id one stays. A row with a null id cannot be told from others like it and stays.
    Only ids are joined: while no more than BROADCAST_IDS go, texts are not shuffled.
    """
    classes = checkpointed(near_duplicate_classes(docs, id_col, text_col, max_bits).select(F.col(id_col).alias("__id"), "component_id"))
    gone = classes.where("__id <> component_id").select("__id").distinct()
    twice = checkpointed(classes.where("__id = component_id").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"))

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    kept = docs.join(bounded(gone), docs[id_col] == F.col("__id"), "left_anti")
    if not twice.limit(1).count():
        return kept
    twice = bounded(twice)
    once = kept.join(twice, kept[id_col] == F.col("__id"), "left_anti")
    return once.unionByName(kept.join(twice, kept[id_col] == F.col("__id"), "left_semi").dropDuplicates([id_col]))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of all ``documents``; nulls, empty texts and repeated rows as in near_duplicate_classes."""
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_pivots": op9_simhash_pivots}
ORACLES: dict[str, str] = {}
