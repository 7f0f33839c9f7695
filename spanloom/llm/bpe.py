"""BPE encoding and decoding by tree concatenation.

A long text is halved until its parts are short. The parts of all texts of a batch are encoded in
one parallel call. Neighbours are then joined upwards: the tokens around a join are encoded again
in a window that grows until its first and last token are those that both sides already have.

Why that is exact. (1) A window only begins and ends at places that the pre-tokenizer treats alike
in any surroundings: where it always splits (before white space that follows anything else, between
letters, digits and other signs), or inside a run of one kind: it splits a run of white space before its last sign at most, and both sides of a cut see that alike. (2) Inside one
pre-token, a token sequence is the BPE encoding if and only if every two neighbours are the
encoding of their own text. Neighbours within the left part, the window and the right part come
from real encodings, and the two pairs at the window's edges are pairs of the left and right
encodings because the window agrees with them there.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_text, table

#: Parts of at most this many characters are encoded whole.
LEAF_CHARS = 16_384
#: Tokens on each side of a join in the first window; each further window has twice as many.
WINDOW_TOKENS = 8
#: With more characters than this in a call, leaves are encoded by so many threads at once (the encoder works outside the interpreter's lock).
PARALLEL_CHARS = 1 << 20
THREADS = 4
VOCABULARY = "byte_bpe_50k.json"
#: Unicode White_Space; fixed by the standard.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def default_vocabulary() -> str:
    """The vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4096)
def kind(ch: str) -> str:
    """The pre-tokenizer's class of a character: space, letter, number or other."""
    if ch in WHITE:
        return "S"
    major = unicodedata.category(ch)[0]
    return major if major in "LN" else "O"


def steady(before: str, after: str) -> bool:
    """Whether a cut between these two characters is treated alike in any surroundings."""
    a, b = kind(before), kind(after)
    if a == "S":
        return b == "S"
    if b == "S" or a == b:
        return b != "O" or after != "'"
    return not (a == "O" and b == "L")


class TreeEncoder:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_TOKENS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf_chars, self.window = max(1, leaf_chars), max(1, window)
        byte = byte_of_char()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes: list[bytes] = []
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            self.bytes.append(token.encode() if token in self.special else bytes(byte[c] for c in token))
        self.decimal = [str(i) for i in range(size)]
        self.pool: ThreadPoolExecutor | None = None
        self.windows = 0  # encoded again so far, for tests and tuning

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _leaf_ids(self, leaves: list[str]) -> list[list[int]]:
        """Ids of all leaves; those of giant texts in parallel, so that one such text does not hold up its task."""
        if sum(map(len, leaves)) <= PARALLEL_CHARS or len(leaves) < 2 * THREADS:
            return self._ids(leaves)
        if self.pool is None:
            self.pool = ThreadPoolExecutor(THREADS)
        share = -(-len(leaves) // (4 * THREADS))
        parts = [leaves[k : k + share] for k in range(0, len(leaves), share)]
        return [ids for part in self.pool.map(self._ids, parts) for ids in part]

    def _units(self, text: str) -> list[str]:
        """The text cut at special tokens, which always stand alone."""
        units, found = [text], [s for s in self.special if s in text]
        for s in found:
            cut = []
            for u in units:
                parts = [u] if u in self.special else u.split(s)
                for k, p in enumerate(parts):
                    cut += ([s] if k else []) + ([p] if p else [])
            units = cut
        return units

    def _halve(self, start: int, stop: int) -> list[tuple[int, int]]:
        if stop - start <= self.leaf_chars:
            return [(start, stop)]
        middle = (start + stop) // 2
        return self._halve(start, middle) + self._halve(middle, stop)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Token ids of each whole text, as one call on the whole text would give."""
        leaves: list[str] = []
        plans: list[list[tuple[str, int, list]]] = []
        for text in texts:
            plan = []
            for unit in [text] if len(text) <= self.leaf_chars else self._units(text):
                spans = [(0, len(unit))] if unit in self.special else self._halve(0, len(unit))
                plan.append((unit, len(leaves), spans))
                leaves += [unit[a:b] for a, b in spans]
            plans.append(plan)
        ids = self._leaf_ids(leaves)
        out = []
        for plan in plans:
            row: list[int] = []
            for unit, first, spans in plan:
                row += ids[first] if len(spans) == 1 else self._tree(unit, spans, ids[first : first + len(spans)])
            out.append(row)
        return out

    def _tree(self, unit: str, spans: list[tuple[int, int]], parts: list[list[int]]) -> list[int]:
        """Join neighbouring parts pairwise, level by level."""
        nodes = [(ids, unit[a:b].encode()) for (a, b), ids in zip(spans, parts, strict=True)]
        while len(nodes) > 1:
            joined = [self._join(*nodes[k], *nodes[k + 1]) for k in range(0, len(nodes) - 1, 2)]
            nodes = joined + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][0]

    def _join(self, left: list[int], lb: bytes, right: list[int], rb: bytes) -> tuple[list[int], bytes]:
        k, whole = self.window, lb + rb
        while True:
            i, a = self._edge_left(left, whole, len(lb), k)
            j, b = self._edge_right(right, whole, len(lb), k)
            new = self._ids([whole[a:b].decode()])[0]
            self.windows += 1
            same_left = i == 0 or new[:1] == left[i : i + 1]
            same_right = j == len(right) or new[-1:] == right[j - 1 : j]
            if same_left and same_right:
                return left[:i] + new + right[j:], whole
            k *= 2

    def _steady_at(self, text: bytes, at: int) -> bool:
        if text[at] & 0xC0 == 0x80:
            return False
        start = at - 1
        while text[start] & 0xC0 == 0x80:
            start -= 1
        stop = at + 1
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        if text[start - 1 : start] == b"'" and kind(text[start:at].decode()) == "L":
            return False  # perhaps inside a contraction such as 'll
        return steady(text[start:at].decode(), text[at:stop].decode())

    def _edge_left(self, ids: list[int], text: bytes, middle: int, k: int) -> tuple[int, int]:
        """The last steady token edge that leaves k tokens or more of the left part in the window."""
        i, at = len(ids), middle
        while i > 0:
            i -= 1
            at -= len(self.bytes[ids[i]])
            if i == 0 or (len(ids) - i >= k and self._steady_at(text, at)):
                return i, at
        return 0, 0

    def _edge_right(self, ids: list[int], text: bytes, middle: int, k: int) -> tuple[int, int]:
        j, at = 0, middle
        while j < len(ids):
            at += len(self.bytes[ids[j]])
            j += 1
            if j == len(ids) or (j >= k and self._steady_at(text, at)):
                return j, at
        return len(ids), len(text)

    def decode(self, rows: Sequence[Sequence[int]]) -> list[str]:
        """Texts of token ids; special tokens stay, bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes.__getitem__
        return [b"".join(map(of, ids)).decode(errors="replace") for ids in rows]


_worker: dict[tuple, TreeEncoder] = {}


def worker_encoder(path: str | None = None, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_TOKENS) -> TreeEncoder:
    """This worker's encoder, made on first use. Without a path the vocabulary is looked up where it runs."""
    key = (path, leaf_chars, window)
    if key not in _worker:
        _worker[key] = TreeEncoder(path or default_vocabulary(), leaf_chars, window)
    return _worker[key]


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode_documents(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``ids array<int>`` of every whole text, beside the columns in ``keep``.

    Null and empty texts give an empty array. Repeated rows are encoded each. Other columns go; a
    kept column named ids gives way to the result.
    """

    def make():
        encoder = worker_encoder(path, leaf_chars)
        return lambda texts: [encoder.encode(texts)]

    return map_text(df, make, IDS, text_col, keep)


def decode_ids(df: DataFrame, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``text string`` of every id array, beside the columns in ``keep``; null and empty arrays give an empty text."""
    import pyarrow as pa


    bound_batches(df.sparkSession)
    keep = [c for c in keep if c != "text"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches):
        encoder = worker_encoder(path)
        for b in batches:
            texts = encoder.decode([x or [] for x in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(encoder: TreeEncoder, rows: list[list[int]]) -> list[list]:
    """Columns of DIGEST for the ids of some texts."""
    decimal, sha = encoder.decimal.__getitem__, hashlib.sha256
    return [
        [len(ids) for ids in rows],
        [sha(",".join(map(decimal, ids)).encode()).hexdigest() for ids in rows],
        [sha(t.encode()).hexdigest() for t in encoder.decode(rows)],
    ]


def digest_documents(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode every whole text in one pass and keep digests: n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    Null texts count as empty: 0 tokens and the digest of nothing.
    """

    def make():
        encoder = worker_encoder(path, leaf_chars)
        return lambda texts: digests(encoder, encoder.encode(texts))

    return map_text(df, make, DIGEST, text_col, keep)


def encode_and_digest(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns of digest_documents and encode_documents in one pass."""

    def make():
        encoder = worker_encoder(path, leaf_chars)

        def run(texts):
            rows = encoder.encode(texts)
            return [*digests(encoder, rows), rows]

        return run

    return map_text(df, make, T.StructType([*DIGEST, *IDS]), text_col, keep)


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all ``documents``; nulls, empty and long texts as in digest_documents."""
    return digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe_tree": op1_bpe_tree}
ORACLES: dict[str, str] = {}
