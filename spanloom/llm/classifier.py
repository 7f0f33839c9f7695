"""Quality classifier of supervised subword embeddings.

Every word, every character n-gram of it and every pair "same word again" has a learned vector in a
hashed table. A document is the mean of the vectors of all its features, a softmax layer gives the
two labels' probabilities, and all parameters are trained together by stochastic gradient descent
in numpy. As the output is linear in the mean, scoring needs one number per feature: the vector's
product with the difference of the two output rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table
from .training import held_out, labelled_sample

#: The model is fitted on at most this many labelled documents.
TRAIN_ROWS = 4_000
BUCKETS = 1 << 17
DIM = 8
ORDERS = (3, 4)
EPOCHS = 12
RATE = 2.0
SEED = 11
#: Words that a worker remembers at once; the memory is emptied when full.
REMEMBER = 150_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: The feature that a word equal to the one before it adds.
AGAIN = "\x00again"


def bucket(feature: str) -> int:
    return crc32(feature.encode()) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word and of the character n-grams of the word between marks."""
    marked = f"<{word}>"
    grams = [bucket(marked[i : i + n]) for n in ORDERS for i in range(len(marked) - n + 1)]
    return [bucket(f"\x00{word}"), *grams]


def document_counts(text: str) -> tuple[Counter, int]:
    """Words with their counts, and how often a word follows itself."""
    words = WORDS.findall(text)
    return Counter(words), sum(map(str.__eq__, words, words[1:]))


def document_features(text: str) -> Counter:
    words, again = document_counts(text)
    found: Counter = Counter({bucket(AGAIN): again} if again else {})
    for w, n in words.items():
        for f in word_features(w):
            found[f] += n
    return found


@dataclass
class Model:
    """``scalars`` per bucket and ``bias``: log odds are the mean scalar of the document's features plus the bias."""

    scalars: np.ndarray
    bias: float


def train(docs: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit on (feature buckets, their shares, label) per document. Without documents all scores are 0.5; featureless ones are skipped."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    docs = [d for d in docs if len(d[0])]
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, y = docs[k]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ table[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[y] -= 1
            back = err @ out
            out -= now * np.outer(err, hidden)
            bias -= now * 0.1 * err
            table[ids] -= now * share[:, None] * back[None, :]
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; remembers the sums of words already met."""

    def __init__(self, model: Model):
        self.scalars, self.bias = model.scalars.tolist(), model.bias
        self.known: dict[str, tuple[float, int]] = {}
        self.again = self.scalars[bucket(AGAIN)]

    def word(self, w: str) -> tuple[float, int]:
        features = word_features(w)
        got = (math.fsum(map(self.scalars.__getitem__, features)), len(features))
        if len(w) <= 64:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[w] = got
        return got

    def score(self, text: str) -> float:
        words, again = document_counts(text)
        total, n, known = self.again * again, again, self.known
        for w, times in words.items():
            s, k = known.get(w) or self.word(w)
            total += times * s
            n += times * k
        z = self.bias + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType(), False)), T.StructField("shares", T.ArrayType(T.FloatType(), False))])


def shared_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document's features, and the share that each has of all."""
    found = document_features(text)
    counts = np.fromiter(found.values(), np.float32, len(found))
    return np.fromiter(found.keys(), np.int32, len(found)), counts / max(1.0, counts.sum())


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Model:
    """Train on at most ``rows`` labelled documents that are not held out.

    Features are hashed on the executors; only their buckets and shares come to the driver, as Arrow buffers that are used in place.
    """

    def make():
        return lambda texts: [list(c) for c in zip(*map(shared_features, texts), strict=True)]

    sample = labelled_sample(docs, labels, rows, id_col, label_col, text_col)
    got = map_text(sample, make, FEATURES, "text", ("id", "label")).toArrow()
    data = []
    for b in got.to_batches():
        edges = b.column("features").offsets.to_numpy()
        ids, shares = b.column("features").values.to_numpy(), b.column("shares").values.to_numpy()
        data += [(key, y, ids[i:j], shares[i:j]) for key, y, i, j in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), edges, edges[1:])]
    data.sort(key=lambda d: (d[0], d[1], len(d[2])))
    return train([(ids, shares, y) for _, y, ids, shares in data])


def score_documents(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """``out double`` in 0..1 of every whole text, in one narrow pass.

    Null, empty and wordless texts have no features and get the bias alone. Equal texts get equal
    scores. Other columns go; a kept column with the name of the result gives way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers: half a megabyte, whatever the data

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [[scorer.score(t) for t in texts]]

    return map_text(df, make, T.StructType([T.StructField(out, T.DoubleType())]), text_col, keep)


def op8_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from ``labels.quality`` of those not held out; nulls, empty texts and repeated rows as in score_documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_subword_classifier": op8_subword_classifier}
ORACLES: dict[str, str] = {}
