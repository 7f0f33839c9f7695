"""Quality rules learned as gradient-boosted trees over document statistics.

Trees are grown on binned statistics with logistic loss. Chosen statistics may only push the
verdict one way: a split that breaks its direction is not taken, and both children are bounded by
the middle of their values, so the constraint holds through the whole tree. A fitted forest is a
few flat numpy arrays, and a batch of documents walks all trees at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_text, table
from .training import labelled_sample

#: The trees are fitted on the statistics of at most this many labelled documents.
TRAIN_ROWS = 8_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
#: Least weight of a leaf's second derivatives, and what is added to it.
LEAST_WEIGHT = 2.0
DAMPING = 1.0
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Statistics with their constraint: -1, a larger value never makes a document better; 1, never worse; 0 would be free.
#: Repeated lines and windows are left to the base rule, as sound documents repeat some lines, too.
STATISTICS = {
    "log_words": 1,
    "symbols_per_word": -1,
    "again_share": -1,
    "caps_share": -1,
    "bang_share": -1,
    "wordless_share": -1,
}
CONSTRAINTS = np.array(list(STATISTICS.values()))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCALE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of one odd factor, for hashes of 2, 4 and 8 words.
_FACTORS = {k: np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64)) for k in (1, 2, 4)}


def _groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Small numbers that are equal where both inputs are."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words that lie in a window of eight words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _SCALE
    mixed ^= mixed >> np.uint64(29)
    for step in (1, 2, 4):
        mixed = mixed[:-step] * _FACTORS[step] + mixed[step:]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows would have equal hashes
        return 0
    for step in (1, 2, 4):
        ids = _groups(ids[:-step], ids[step:])
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_statistics(text: str) -> tuple[list[str], tuple[int, int, int, int, int]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return words, (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def statistics(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """Base counts, and the statistics that the trees see; all of them 0 for a text without words."""
    words, base = base_statistics(text)
    n, _, symbols, _, _ = base
    if not n:
        return base, [0.0] * len(STATISTICS)
    return base, [
        float(np.log1p(n)),
        symbols / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        (n - sum(1 for w in words if w[0].isalnum())) / n,
    ]


@dataclass
class Forest:
    """Flat arrays over the nodes of all trees: a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; NaN goes right."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def _best_split(g: np.ndarray, h: np.ndarray, constraint: np.ndarray, low: float, high: float) -> tuple[float, int, int, float, float] | None:
    """Over histograms (features, bins): the gain, feature, last bin on the left, and both bounded values."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = g.sum(axis=1)[:, None] - gl, h.sum(axis=1)[:, None] - hl
    wl, wr = (np.clip(-a / (b + DAMPING), low, high) for a, b in ((gl, hl), (gr, hr)))
    whole = np.clip(-g.sum(axis=1) / (h.sum(axis=1) + DAMPING), low, high)
    loss = lambda a, b, w: a * w + 0.5 * (b + DAMPING) * w * w
    gain = loss(g.sum(axis=1), h.sum(axis=1), whole)[:, None] - loss(gl, hl, wl) - loss(gr, hr, wr)
    fits = (hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & (constraint[:, None] * (wr - wl) >= 0)
    gain = np.where(fits, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b), float(wl[f, b]), float(wr[f, b])) if gain[f, b] > 1e-6 else None


def fit_forest(x: np.ndarray, y: np.ndarray, constraint: np.ndarray = CONSTRAINTS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for labels 0 and 1. Without rows, or with one label, the forest says that label, or keeps all."""
    n, m = x.shape
    share = float(np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for f in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.empty((0, m), int)
    flat = binned + np.arange(m) * BINS
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(value)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    margin = np.full(n, start)
    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = node(float(-grad.sum() / (hess.sum() + DAMPING)))
        roots.append(root)
        open_nodes = [(root, np.arange(n), -np.inf, np.inf)]
        for _level in range(depth):
            after = []
            for at, rows, low, high in open_nodes:
                where = flat[rows].ravel()
                sums = [np.bincount(where, np.repeat(v[rows], m), m * BINS).reshape(m, BINS) for v in (grad, hess)]
                best = _best_split(*sums, constraint, low, high)
                if best is None:
                    continue
                _, f, b, wl, wr = best
                go = binned[rows, f] <= b
                feature[at], threshold[at] = f, float(cuts[f][b]) if b < len(cuts[f]) else np.inf
                left[at], right[at] = node(wl), node(wr)
                middle = (wl + wr) / 2
                lows, highs = [(low, high), (low, middle), (middle, high)], [(low, high), (middle, high), (low, middle)]
                after += [(left[at], rows[go], *lows[constraint[f]]), (right[at], rows[~go], *highs[constraint[f]])]
            open_nodes = after
        tree = Forest(*map(np.array, (feature, threshold, left, right, value)), np.array([root]), 0.0, depth)
        for i in range(root, len(value)):
            value[i] *= rate
        margin += rate * tree.margin(x)
    if not roots:
        roots.append(node(0.0))
    return Forest(*map(np.array, (feature, threshold, left, right, value, roots)), start, depth)


TRAINING = T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType(), False))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Forest:
    """Fit on at most ``rows`` labelled documents that are not held out; only their statistics come to the driver."""
    make = lambda: lambda texts: [[statistics(t)[1] for t in texts]]
    sample = labelled_sample(docs, labels, rows, id_col, label_col, text_col)
    got = map_text(sample, make, TRAINING, "text", ("id", "label")).toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array(got["stats"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit_forest(x, got["label"].to_numpy(float))


RESULT = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality", T.DoubleType())])


def judge_documents(df: DataFrame, forest: Forest, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Base counts, base_failed, kept, and the trees' ``quality`` in 0..1 of every whole text, in one narrow pass.

    Null, empty and wordless texts have zero counts and fail. Equal texts get equal verdicts. Other
    columns go; kept columns named as a result give way.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2 ** (DEPTH + 1) nodes

    def make():
        trees = shared.value

        def run(texts):
            base, stats = zip(*map(statistics, texts), strict=True)
            base = np.array(base, np.int64).reshape(-1, len(BASE))
            quality = 1 / (1 + np.exp(-trees.margin(np.array(stats))))
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            return [*base.T, failed, ~failed & (quality >= 0.5), quality]

        return run

    return map_text(df, make, RESULT, text_col, keep)


def op2_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all ``documents``, learned from ``labels.quality`` of those not held out; nulls, empty texts and repeated rows as in judge_documents."""
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_boosted_rules": op2_boosted_rules}
ORACLES: dict[str, str] = {}
