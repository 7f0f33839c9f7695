"""Sequential scans over long groups in bounded blocks: numbering, running levels, thinning, and the two as one adaptive sampling.

Rows get their number within the group without any group meeting in one task: they are dealt out by ranges of the order, and
only the counts of the pieces are added up. Numbers cut a group into blocks of a fixed size. A scan whose
state fades takes the last rows of the block before as its run-up; one whose state does not is first told what each block would make
of any state that may enter, and those short tables are followed from block to block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialized, tasks
from .online import Ewma

#: Rows of a block, and how many of the block before a running level starts from: by then less than 1e-22 of what it was is left.
BLOCK = 4096
RUN_UP = 1024
#: Rows that one Python call should get: many small blocks share a call.
CALL = 50_000
#: Pieces of groups that are broadcast at once.
PIECES = 200_000
#: Fixed values of sampling: how many samples a recording should have, and the least stride in seconds.
TARGET_SAMPLES = 1600
LEAST_STRIDE = 0.25
#: A time so close below the grid counts as on it.
NEAR = 1e-6


def numbered(df: DataFrame, group: str, order: Sequence[str], out: str = "idx") -> DataFrame:
    """The rows with their number within the group, from 0, by ``order``; ties keep any order, so the order should be total.

    Rows are dealt to ranges of group and order and sorted within them; a piece of a group within a range only needs the number of
    its rows in earlier ranges. The dealt rows are written once, as ranges are drawn by a sample and must not be drawn twice. Pass only the columns that are needed.
    """
    parts = tasks(df.sparkSession)
    dealt = df.repartitionByRange(parts, F.col(group).asc_nulls_first(), *[F.col(c) for c in order]).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    # the id is the number of the range and, in its low 33 bits, the place within it
    held = materialized(dealt.withColumn("__at", F.monotonically_increasing_id()))
    place = held.withColumn("__p", F.shiftright("__at", 33).cast("int"))
    pieces = place.groupBy(group, "__p").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    pieces = materialized(pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col(group).alias("__g"), F.col("__p").alias("__q"), "__first", "__before"))
    side = F.broadcast(pieces) if pieces.count() <= PIECES else pieces
    joined = place.join(side, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__p", "__g", "__q", "__first", "__before")


def by_call(df: DataFrame, rows: int, keys: Sequence[str], numbers: Sequence[str], kept: Sequence[str], run: Callable[[dict[str, np.ndarray], list[int]], tuple[np.ndarray, dict[str, list | np.ndarray]]], schema: str) -> DataFrame:
    """``run`` over the rows of many keys in one Python call, as small groups cost more to call than to work on: keys are dealt by a hash to calls of about CALL of all ``rows``.

    ``run`` gets ``numbers``, sorted by keys and the first of them, and the bounds of each key's rows; it gives the places of rows whose ``kept`` columns go out, and new columns beside them. Keys may be null.
    """
    calls = max(1, -(-rows // CALL))

    def each(table: pa.Table) -> pa.Table:
        codes = [np.asarray(pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode").indices) for k in keys]
        held = {c: table.column(c).to_numpy() for c in numbers}  # a list is an array of its own
        place = np.lexsort([held[numbers[0]], *codes[::-1]])
        change = np.any([np.diff(c[place], prepend=-1) != 0 for c in codes], axis=0)
        out, made = run({c: x[place] for c, x in held.items()}, [*np.flatnonzero(change).tolist(), len(place)])
        picked = table.select(list(kept)).take(pa.array(place[out]))
        for name, values in made.items():
            picked = picked.append_column(name, pa.array(values))
        return picked

    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(calls)).alias("__call")).applyInArrow(each, schema)


def spikes(df: DataFrame, group: str, row_id: str, delta: str, number: str = "idx", block: int = BLOCK, run_up: int = RUN_UP) -> DataFrame:
    """group, id, number, spike: jumps above the group's running level and spread (0 where there is none), in the order of ``number``.

    Every block runs over the last ``run_up`` rows of the one before, from nothing, so no state is passed on. A null delta counts as 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    d = df.select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(number).cast("long").alias("k"), F.coalesce(F.col(delta).cast("double"), F.lit(0.0)).alias("x"))
    b = F.floor(F.col("k") / block)
    dealt = d.withColumn("b", F.explode(F.when(F.col("k") % block >= block - run_up, F.array(b, b + 1)).otherwise(F.array(b))))

    def run(rows: dict[str, np.ndarray], cuts: list[int]) -> tuple[np.ndarray, dict]:
        found, values = [], rows["x"].tolist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            state = Ewma()
            state.seen = int(rows["k"][low])
            found += [state.push(x) for x in values[low:high]]
        mine = np.flatnonzero(rows["k"] // block == rows["b"])
        return mine, {"spike": np.array(found)[mine]}

    out = by_call(dealt, df.count(), ["g", "b"], ["k", "b", "x"], ["g", "id", "k"], run, f"g {kinds[group]}, id {kinds[row_id]}, k long, spike double")
    return out.select(F.col("g").alias(group), F.col("id").alias(row_id), F.col("k").alias(number), "spike")


def following(t: np.ndarray, spike: np.ndarray, stride: float) -> np.ndarray:
    """For each row the next one kept if it is: the first later one a stride away, or with a spike; the number of rows if none is."""
    n = len(t)
    after = np.maximum(np.searchsorted(t + NEAR, t + stride, "left"), np.arange(n) + 1)
    marks = np.append(np.flatnonzero(spike), n)
    return np.minimum(after, marks[np.searchsorted(marks, np.arange(n), "right")])


def entry(t: np.ndarray, spike: np.ndarray, due: float) -> int:
    """The first row kept where the next sample is due at a time; the number of rows if none is."""
    marks = np.flatnonzero(spike)
    return min(int(np.searchsorted(t + NEAR, due, "left")), int(marks[0]) if len(marks) else len(t))


def thinned(df: DataFrame, group: str, time: str, row_id: str, stride: Column | float, spike: str | None = None, number: str = "idx", block: int = BLOCK) -> DataFrame:
    """group, id, t, spike of the rows kept in the order of ``number`` (which must be that of time): a first one, each that is a stride or more after the last one kept, and each with a spike.

    ``stride`` may be a column that is constant within a group. A block of rows tells, for each row that may be its first kept one, the time of the last one kept from there; a group's
    tables, a row per block, are followed in order, and each block then keeps its rows. Rows without a time go.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    s = F.coalesce(F.col(spike).cast("double"), F.lit(0.0)) if spike else F.lit(0.0)
    d = df.where(F.col(time).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(time).cast("double").alias("t"), s.alias("s"), F.col(number).cast("long").alias("k"), (stride if isinstance(stride, Column) else F.lit(float(stride))).cast("double").alias("w"))
    d = d.withColumn("b", F.floor(F.col("k") / block))

    n = df.count()

    def table(rows: dict[str, np.ndarray], cuts: list[int]) -> tuple[np.ndarray, dict]:
        opens, ends, marked = [], [], []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            t, mark, w = rows["t"][low:high], rows["s"][low:high] > 0, float(rows["w"][low])
            n, nxt = len(t), following(t, mark, w).tolist()
            last = list(range(n))
            for i in range(n - 1, -1, -1):
                if nxt[i] < n:
                    last[i] = last[nxt[i]]
            # what is due before the block is due within a stride of its first row
            most = min(entry(t, mark, np.inf), int(np.searchsorted(t, t[0] + w + 2 * NEAR, "right")), n - 1)
            opens.append((t[: most + 1] + NEAR).tolist())
            ends.append(t[last[: most + 1]].tolist())
            marked.append(bool(most < n and mark[most]))
        return np.array(cuts[:-1], np.int64), {"opens": opens, "ends": ends, "marked": marked}

    tables = by_call(d, n, ["g", "b"], ["k", "t", "s", "w"], ["g", "b", "w"], table, f"g {kinds[group]}, b long, w double, opens array<double>, ends array<double>, marked boolean")

    def follow(rows: dict[str, np.ndarray], cuts: list[int]) -> tuple[np.ndarray, dict]:
        dues = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            due = -np.inf
            for i in range(low, high):
                dues.append(due)
                opens = rows["opens"][i]
                k = bisect_left(opens, due)
                if k == len(opens) and rows["marked"][i]:
                    k -= 1
                if k < len(opens):
                    due = rows["ends"][i][k] + float(rows["w"][i])
        return np.arange(len(dues)), {"due": np.array(dues)}

    dues = by_call(tables, n, ["g"], ["b", "w", "opens", "ends", "marked"], ["g", "b"], follow, f"g {kinds[group]}, b long, due double").select(F.col("g").alias("h"), F.col("b").alias("c"), "due")

    def keep(rows: dict[str, np.ndarray], cuts: list[int]) -> tuple[np.ndarray, dict]:
        kept = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            t, mark = rows["t"][low:high], rows["s"][low:high] > 0
            nxt, at = following(t, mark, float(rows["w"][low])), entry(t, mark, float(rows["due"][low]))
            while at < len(t):
                kept.append(low + at)
                at = int(nxt[at])
        return np.array(kept, np.int64), {}

    given = d.join(dues, F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("c"))).drop("h", "c")
    out = by_call(given, n, ["g", "b"], ["k", "t", "s", "w", "due"], ["g", "id", "t", "s"], keep, f"g {kinds[group]}, id {kinds[row_id]}, t double, s double")
    return out.select(F.col("g").alias(group), F.col("id").alias(row_id), "t", F.col("s").alias("spike"))


def estimated_stride(duration: Column, target: int = TARGET_SAMPLES, least: float = LEAST_STRIDE) -> Column:
    """Seconds between samples: about ``target`` in a recording of any length, none closer than ``least``."""
    return F.when(duration > 0, F.greatest(F.lit(least), duration / max(target, 1))).otherwise(F.lit(least))


def adaptive_samples(df: DataFrame, group: str, time: str, row_id: str, delta: str, target: int = TARGET_SAMPLES, least: float = LEAST_STRIDE, block: int = BLOCK, run_up: int = RUN_UP) -> DataFrame:
    """group, id, t, spike, signal: the frames of each recording worth a closer look.

    Two sources under one stride: a grid that gives about ``target`` samples whatever the length, and every frame whose ``delta`` (0..1, to the frame before) jumps above the
    running level; a jump restarts the grid. So brief events survive on long recordings, and samples are bounded by the grid and the jumps. ``signal`` is the delta in
    hundredths, at least the jump's size where there is one. Frames without a time go; equal times go by id.
    """
    rows = df.where(F.col(time).isNotNull()).select(F.col(group), F.col(row_id), F.col(time).cast("double").alias("__t"), F.col(delta).cast("double").alias("__d"))
    lengths = rows.groupBy(group).agg((F.max("__t") - F.min("__t")).alias("__length"))
    frames = materialized(numbered(rows, group, ["__t", row_id], "__k"))
    jumps = spikes(frames, group, row_id, "__d", "__k", block, run_up).select(F.col(group).alias("__g"), F.col("__k").alias("__j"), "spike")
    strides = lengths.select(F.col(group).alias("__h"), estimated_stride(F.col("__length"), target, least).alias("__w"))
    joined = frames.join(jumps, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__k") == F.col("__j"))).drop("__g", "__j").join(strides, F.col(group).eqNullSafe(F.col("__h"))).drop("__h")
    both = materialized(joined.withColumn("__row", F.struct(row_id, "__d")))
    kept = thinned(both, group, "__t", "__row", F.col("__w"), "spike", "__k", block)
    signal = F.greatest(100 * F.coalesce(F.col("__row.__d"), F.lit(0.0)), 100 * F.col("spike"))
    return kept.select(group, F.col(f"__row.{row_id}").alias(row_id), "t", "spike", signal.alias("signal"))
