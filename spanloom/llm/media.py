"""Media columns as ISO media containers.

A payload is stored as the frames of an uncompressed 8-bit grey video track: nested boxes with
sample tables, then the frames. Reading walks the boxes, decodes the sample tables and gives codec,
duration and the byte ranges of key frames; payload bytes are sliced by those tables, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_text, table

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT  # one byte a pixel
FRAMES_PER_SECOND = 25
FRAMES_PER_CHUNK = 64
KEY_EVERY = 12
CODEC = b"raw "
#: Boxes that hold boxes; fixed by the format.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
#: Flags of a fragment's header and run; fixed by the format.
BASE_OFFSET, DESCRIPTION, DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
DATA_OFFSET, FIRST_FLAGS, DURATIONS, SIZES, FLAGS, SHIFTS = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_KEY = 0x10000
#: Boxes nest eight deep in the format; what is deeper is damage and not entered.
DEEPEST = 32
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """The bytes, followed by bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def store(payload: bytes) -> bytes:
    """A complete container file whose frames are the payload, a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    if n < 1 or n * FRAME != len(payload):
        raise ValueError("the payload must be a positive multiple of the frame size")
    chunks, rest = divmod(n, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK)] if chunks else []
    if rest:
        runs.append((chunks + 1, rest))
    starts = np.arange(0, n, FRAMES_PER_CHUNK, dtype=np.int64) * FRAME
    keys = np.arange(1, n + 1, KEY_EVERY).astype(">u4")
    wide = len(payload) >= 1 << 31
    entry = box(CODEC, struct.pack(">6xH16xHHIIIH32xHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, 40, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")

    def movie(first: int) -> bytes:
        offsets = starts + first
        place = full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes())
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            place,
        )
        data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), data, tables)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FRAMES_PER_SECOND, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12xx", 0, b"vide")), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0, 0), IDENTITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, FRAMES_PER_SECOND, n, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2)), track)

    lead = 16 if wide else 8
    first = len(head) + len(movie(0)) + lead
    size = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((head, movie(first), size, payload))


def walk(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, body start and body end of every box, outer before inner, at any depth to DEEPEST; a box cut short ends the walk of its level."""
    levels: list[tuple[tuple[bytes, ...], int, int]] = [((), start, len(data) if stop is None else stop)]
    while levels:
        outer, start, stop = levels.pop()
        if start + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= stop:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        end = stop if size == 0 else start + size
        if end < body or end > stop:
            continue
        path = (*outer, kind)
        yield path, body, end
        levels.append((outer, end, stop))
        if kind in CONTAINERS and len(path) < DEEPEST:
            levels.append((path, body, end))


@dataclass
class Track:
    """What the boxes say: codec, times in units of timescale, and for every sample its bytes and whether it is a key frame."""

    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    contiguous: bool


def _table(data: bytes, at: int, end: int, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    """The rows behind a count, as whole numbers."""
    n = struct.unpack_from(">I", data, at + skip)[0]
    width = columns * int(kind[-1])
    n = min(n, (end - at - skip - 4) // width)
    return np.frombuffer(data, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


class Damaged(ValueError):
    """The boxes of a file do not fit together."""


def _fragments(data: bytes, boxes: list[tuple[tuple[bytes, ...], int, int]], track_id: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Duration, sample starts, sizes and key frames of a track that is stored in movie fragments."""
    defaults = {struct.unpack_from(">I", data, a + 4)[0]: struct.unpack_from(">III", data, a + 12) for p, a, _ in boxes if p == (b"moov", b"mvex", b"trex")}
    starts, sizes, keys = [], [], []
    duration = n_before = 0
    moof = base = at = 0
    own, length, size, flags = False, 0, 0, 0
    for path, a, b in boxes:
        if path == (b"moof",):
            moof = a - 8
        elif path == (b"moof", b"traf"):
            own = False
        elif path == (b"moof", b"traf", b"tfhd"):
            bits, track = struct.unpack_from(">II", data, a)
            own = track == track_id
            length, size, flags = defaults.get(track, (0, 0, 0))
            at = a + 8
            base = moof
            if bits & BASE_OFFSET:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(bits & DESCRIPTION)
            if bits & DEFAULT_DURATION:
                length, at = struct.unpack_from(">I", data, at)[0], at + 4
            if bits & DEFAULT_SIZE:
                size, at = struct.unpack_from(">I", data, at)[0], at + 4
            if bits & DEFAULT_FLAGS:
                flags = struct.unpack_from(">I", data, at)[0]
            at = base
        elif path == (b"moof", b"traf", b"trun") and own:
            bits, n = struct.unpack_from(">II", data, a)
            p = a + 8
            if bits & DATA_OFFSET:
                at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
            first_flags = flags
            if bits & FIRST_FLAGS:
                first_flags, p = struct.unpack_from(">I", data, p)[0], p + 4
            columns = [f for f in (DURATIONS, SIZES, FLAGS, SHIFTS) if bits & f]
            if n > ((b - p) // (4 * len(columns)) if columns else len(data) // max(size, 1)) or n_before + n > len(data):
                raise Damaged("more samples than the file can hold")
            rows = np.frombuffer(data, ">u4", n * len(columns), p).astype(np.int64).reshape(n, len(columns))
            one = {f: rows[:, k] for k, f in enumerate(columns)}
            each = one.get(SIZES, np.full(n, size, np.int64))
            marks = one.get(FLAGS, np.full(n, flags, np.int64)).copy()
            if n and bits & FIRST_FLAGS:
                marks[0] = first_flags
            ends = at + np.cumsum(each)
            starts.append(ends - each)
            sizes.append(each)
            keys.append(n_before + np.flatnonzero((marks & NOT_KEY) == 0))
            duration += int(one[DURATIONS].sum()) if DURATIONS in one else n * length
            n_before += n
            at = int(ends[-1]) if n else at
    none = np.zeros(0, np.int64)
    return duration, *(np.concatenate(x) if x else none for x in (starts, sizes, keys))


def read(data: bytes) -> Track | None:
    """The first track with samples, in one piece or in movie fragments; None where there is none or its tables do not fit together.

    Counts in the file are held against its length before anything of that size is made.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    boxes = []
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].setdefault(path[-1], (a, b))
        elif path[0] == b"moof" or path == (b"moov", b"mvex", b"trex"):
            boxes.append((path, a, b))
    for found in tracks:
        try:
            if track := _track(data, found, boxes):
                return track
        except (KeyError, struct.error, ValueError, IndexError, OverflowError):
            continue
    return None


def _track(data: bytes, found: dict[bytes, tuple[int, int]], boxes: list) -> Track | None:
    """The track of these boxes; None where it has no samples."""
    a, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
    a, _ = found[b"stsd"]
    codec, _, width, height = struct.unpack_from(">4s6xH16xHH", data, a + 12)
    a, b = found[b"stsz"]
    same, n = struct.unpack_from(">II", data, a + 4)
    if n == 0 and boxes:
        a, _ = found[b"tkhd"]
        duration, starts, sizes, keys = _fragments(data, boxes, struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0])
    else:
        # a sample has a byte of the file or an entry in its table; empty ones of one size have neither
        if n > (len(data) // same if same else (b - a - 12) // 4):
            raise Damaged("more samples than the file can hold")
        sizes = np.full(n, same, np.int64) if same else _table(data, a + 4, b, 1)[:, 0]
        chunk = _table(data, *found[b"co64"], 1, ">u8")[:, 0] if b"co64" in found else _table(data, *found[b"stco"], 1)[:, 0]
        runs = _table(data, *found[b"stsc"], 3)
        chunks = np.diff(np.r_[runs[:, 0], len(chunk) + 1])
        if (chunks < 0).any() or chunks.sum() != len(chunk) or int((runs[:, 1] * chunks).sum()) != n:
            raise Damaged("samples and chunks differ")
        per_chunk = np.repeat(runs[:, 1], chunks)
        keys = _table(data, *found[b"stss"], 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
        before = np.r_[0, np.cumsum(sizes)]
        firsts = np.r_[0, np.cumsum(per_chunk)][:-1]
        starts = np.repeat(chunk - before[firsts], per_chunk) + before[:-1]
    if not len(sizes):
        return None
    if starts.min() < 0 or (starts + sizes).max() > len(data) or keys.max(initial=0) >= len(sizes) or keys.min(initial=0) < 0:
        raise Damaged("samples beyond the file")
    contiguous = bool((starts[1:] == starts[:-1] + sizes[:-1]).all())
    # overlapping samples would multiply the file
    if not contiguous and int(sizes.sum()) > len(data):
        raise Damaged("samples overlap")
    return Track(codec.decode("latin-1"), width, height, timescale, duration, starts, sizes, keys, contiguous)


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order."""
    if track.contiguous:
        return data[track.starts[0] : track.starts[-1] + track.sizes[-1]]
    return b"".join(data[s : s + k] for s, k in zip(track.starts.tolist(), track.sizes.tolist(), strict=True))


def store_documents(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``n_bytes long, media binary``: every whole text in UTF-8, padded to whole frames, as a container file.

    Null and empty texts become one frame of bytes 255. Other columns go; kept ones named as a result give way.
    """

    def make():
        def run(texts):
            raw = [t.encode() for t in texts]
            return [[len(r) for r in raw], [store(padded(r)) for r in raw]]

        return run

    return map_text(df, make, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), text_col, keep)


PROBE = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def probe(data: bytes) -> tuple:
    """One row of PROBE; what a damaged file does not tell is null, its size and digest are always there."""
    stored = (len(data), hashlib.sha256(data).hexdigest())
    track = read(data)
    if track is None:
        return (None,) * 8 + stored + (None,)
    bytes_back = payload(data, track)
    starts = track.starts[track.keys]
    ends = starts + track.sizes[track.keys]
    ranges = np.stack([starts, ends], axis=1)
    seconds = track.duration / track.timescale if track.timescale else None
    first, last = (f"{a}-{b}" for a, b in ranges[[0, -1]]) if len(ranges) else ("", "")
    feature = f"{track.codec.strip()};{track.width}x{track.height};{track.duration}/{track.timescale};samples={len(track.sizes)};keys={len(ranges)};first={first};last={last};ranges={crc32(ranges.astype('<i8').tobytes()):08x}"
    keys = [{"start": a, "end": b} for a, b in ranges.tolist()]
    return (track.codec, track.width, track.height, seconds, keys, len(bytes_back), hashlib.sha256(bytes_back).hexdigest(), crc32(bytes_back[-32:]), *stored, feature)


def probe_media(df: DataFrame, media_col: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Features of stored files: codec, size, seconds, key frames' byte ranges, digests. Null files count as empty, hence damaged."""
    bound_batches(df.sparkSession)
    names = {f.name for f in PROBE}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(PROBE))
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(PROBE)]

    def run(batches):
        for b in batches:
            rows = [probe(x.as_py() or b"") for x in b.column(len(keep))]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + cols, names=schema.names)

    return df.select(*keep, F.col(media_col).alias("__media")).mapInArrow(run, schema)


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as containers and read back; nulls, empty and long texts as in store_documents."""
    stored = store_documents(table(spark, sf_dir, "documents"))
    probed = probe_media(stored, keep=("doc_id", "n_bytes"))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds")


QUERIES = {"op6_iso_media": op6_iso_media}
ORACLES: dict[str, str] = {}
