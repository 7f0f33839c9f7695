"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its lower-case words between spaces,
hashed into buckets by a rolling hash over code points. Over the labelled sample, executors count in how many toxic and
other documents each bucket stands; its log-count ratio is how much more of the toxic documents have it. The buckets that tell most about the label
are the features; each counts as its ratio where present, and a logistic regression with a penalty is
fitted on them in numpy. Ratio and weight then make one number per bucket, so a score is a sum over a text's distinct buckets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, map_text, table
from .training import held_out, labelled_sample

#: The model is fitted on at most this many labelled documents.
TRAIN_ROWS = 8_000
#: Documents whose crc32 leaves 2 modulo 4 are never trained on.
FOLD = (4, 2)
ORDERS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
#: Buckets that the regression uses: those that tell most about the label.
FEATURES = 1 << 11
#: Added to both counts of a bucket before their ratio is taken.
SMOOTH = 1.0
#: Of the regression: steps, their size, strength of the penalty on weights.
STEPS = 200
RATE = 0.05
PENALTY = 1e-3
THRESHOLD = 0.3
#: Characters that are hashed at once.
WINDOW = 500_000
#: Multipliers of the rolling and of the final hash; odd, with bits all over.
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
NOT_WORD = re.compile(r"[\W_]+")


class Grams:
    """Finds the distinct buckets of texts, in time and memory that follow the text and a window of it."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int32)

    def distinct(self, buckets: np.ndarray) -> np.ndarray:
        """Each bucket once: where it stands last."""
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order
        return buckets[self.last[buckets] == order]

    def window(self, codes: np.ndarray) -> np.ndarray:
        found, rolled = [], codes
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            rolled = rolled[:-1] * ROLL + codes[n - 1 :]
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * MIX
                found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        return self.distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def of(self, text: str) -> np.ndarray:
        """The distinct buckets of the whole text; none where it has no word."""
        words = NOT_WORD.sub(" ", text.lower()).strip()
        if not words:
            return np.zeros(0, np.int64)
        marked = f" {words} "
        step = WINDOW - max(ORDERS) + 1  # windows share what keeps every n-gram whole in one of them
        parts = [self.window(np.frombuffer(marked[i : i + WINDOW].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)) for i in range(0, max(1, len(marked) - max(ORDERS) + 1), step)]
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass
class Model:
    """``scalars`` per bucket and ``bias``: log odds are the sum of the scalars of a document's distinct buckets, and the bias."""

    scalars: np.ndarray
    bias: float


def log_ratios(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Per bucket: the log of its share among the buckets of toxic documents over that among those of others, both smoothed."""
    p, q = toxic + SMOOTH, other + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def telling(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, most: int) -> np.ndarray:
    """The at most ``most`` buckets whose presence tells most about the label (mutual information), ascending; ties go to smaller numbers."""
    n = n_toxic + n_other
    gain = np.zeros(len(toxic))
    for here, of_label in ((toxic, n_toxic), (other, n_other)):
        for cell, of_presence in ((here, toxic + other), (of_label - here, n - toxic - other)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(cell > 0, cell * np.log(cell * n / (of_presence * float(of_label))), 0.0)
    order = np.argsort(-gain, kind="stable")[:most]
    return np.sort(order[gain[order] > 1e-9])


def regression(docs: Sequence[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias, by logistic loss with a penalty. A document is the numbers of its features, each of which counts as its ratio."""
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = np.concatenate(docs) if len(rows) else np.zeros(0, np.int64)
    values = ratios[cols]
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w, bias = np.zeros(len(ratios)), math.log(share / (1 - share))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], len(docs)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(docs)
        g, gb = np.bincount(cols, values * err[rows], len(w)) + PENALTY * w, err.sum()
        # steps adapted to each weight by running means of its gradient and its square
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / a) / (np.sqrt(s / b) + 1e-8)
        bias -= RATE * (mb / a) / (math.sqrt(sb / b) + 1e-8)
    return w, bias


COUNTS = "bucket int, toxic long, other long"


def bucket_counts(sample: DataFrame) -> DataFrame:
    """``bucket, toxic, other``: in how many documents of each label a bucket stands. A task adds up its own, so a bucket is one row per task; bucket -1 counts documents."""
    bound_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[1 - label, grams.of(text or "")] += 1
                counts[1 - label, BUCKETS] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(seen, max(1, len(seen) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(part == BUCKETS, -1, part), pa.int32()), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["bucket", "toxic", "other"])

    return sample.select("label", "text").mapInArrow(run, COUNTS).groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


FOUND = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType(), False))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", fold: tuple[int, int] = FOLD) -> Model:
    """Train on at most ``rows`` labelled documents that are not held out.

    What comes to the driver is bounded: the counts of at most BUCKETS buckets, and of each document of the sample those that are
    among FEATURES. Of rows with the same id one counts, that of the least text, so that a repeated id does not swell the sample, which is
    written once and read twice. Without documents of both labels every score is the share of toxic ones, none counting as 0.
    """
    sample = checkpointed(labelled_sample(docs, labels, rows, id_col, label_col, text_col, fold).groupBy("id", "label").agg(F.min("text").alias("text")))
    counts = bucket_counts(sample).toArrow()
    bucket, toxic, other = (counts.column(i).to_numpy() for i in range(3))
    here = bucket >= 0
    n_toxic, n_other = int(toxic[~here].sum()), int(other[~here].sum())
    scalars = np.zeros(BUCKETS)
    if not n_toxic or not n_other:
        return Model(scalars, 700.0 if n_toxic else -700.0)
    all_toxic, all_other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    all_toxic[bucket[here]], all_other[bucket[here]] = toxic[here], other[here]
    ratios = log_ratios(all_toxic, all_other)
    used = telling(all_toxic, all_other, n_toxic, n_other, FEATURES)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    shared = docs.sparkSession.sparkContext.broadcast(number)  # BUCKETS numbers: four megabytes, whatever the data

    def make():
        grams = Grams()

        def features(text: str) -> np.ndarray:
            found = shared.value[grams.of(text)]
            return np.sort(found[found >= 0])

        return lambda texts: [[features(t) for t in texts]]

    got = map_text(sample, make, FOUND, "text", ("id", "label")).toArrow()
    data = []
    for b in got.to_batches():
        edges, values = b.column("features").offsets.to_numpy(), b.column("features").values.to_numpy()
        data += [(key, y, values[i:j]) for key, y, i, j in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), edges, edges[1:])]
    data.sort(key=lambda d: (d[0], d[1], d[2].tobytes()))
    weights, bias = regression([f for *_, f in data], np.array([y for _, y, _ in data], float), ratios[used])
    scalars[used] = weights * ratios[used]
    return Model(scalars, bias)


def score_documents(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """``out double`` in 0..1 of every whole text, in one narrow pass.

    Null, empty and wordless texts have no features and get the bias alone; equal texts get equal scores. Other columns go; a kept
    column with the name of the result gives way to it. An empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers: eight megabytes, whatever the data

    def make():
        grams, model = Grams(), shared.value

        def score(text: str) -> float:
            z = model.bias + float(model.scalars[grams.of(text)].sum())
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        return lambda texts: [[score(t) for t in texts]]

    return map_text(df, make, T.StructType([T.StructField(out, T.DoubleType())]), text_col, keep)


def op13_char_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from ``labels.toxic`` of those not held out; nulls, empty and long texts as in score_documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op13_char_ngram_toxicity": op13_char_ngram_toxicity}
ORACLES: dict[str, str] = {}
