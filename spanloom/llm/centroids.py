"""Centroid clustering by delta Lloyd rounds over integer vectors.

The state, written to the shared folder each round, holds every vector with its owner and its exact
distance to it. A round reads it once. Where the owner stayed, or moved no further away, only the
centroids that changed are compared; a vector whose owner moved away is compared with all. What
changes owner is added up within the task as signed integer transfers, a row per cluster that the
task touches, which ride in the same table. The driver keeps the global sums, k vectors, and adds the transfers to them:
new centroids are exact floors of sums over counts. When no centroid changes, later rounds would change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, remove_folder, scratch_folder, table

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
#: A component x counts as floor(SCALE * x).
SCALE = 1024
SALT = "3:"
#: Integer components stay within this, either way.
LIMIT = 1 << 62
#: Below this, squared distances of up to 2**9 components are exact in doubles.
EXACT = 1 << 20
MOST = (1 << 63) - 1
SUMS = T.DecimalType(38, 0)
VECTOR = T.ArrayType(T.LongType(), False)


def integers(lists: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors of ``dims`` finite components, and those as integers."""
    offsets = lists.offsets.to_numpy()
    whole = (np.diff(offsets) == dims) & lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.values.to_numpy(zero_copy_only=False)
    values = flat[(offsets[:-1][whole, None] + np.arange(dims)).ravel()].reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    whole[np.flatnonzero(whole)[~finite]] = False
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values[finite])
    # doubles at the bound are LIMIT itself; everything below it is an exact integer
    return whole, np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64)


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vector, centroid), as int64, or as Python integers where components are large."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(axis=1)[:, None] - 2 * v @ c.T + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    v, c = vectors.astype(object), centroids.astype(object)
    out = np.empty((len(v), len(c)), object)
    for j, row in enumerate(c):
        diff = v - row
        out[:, j] = (diff * diff).sum(axis=1)
    return out


def reassign(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances under ``centroids``, of which those in ``changed`` (ascending) differ from the ones that ``owner`` and ``distance`` are of.

    Ties go to the smaller number. An owner of -1 and a distance of -1 are unknown.
    """
    # an unchanged owner precedes all unchanged centroids, as does a changed one that is no further than it was
    near = squares(vectors, centroids[changed])
    kind = near.dtype
    distance = distance.astype(kind)
    place = np.full(len(centroids) + 1, -1)
    place[changed] = np.arange(len(changed))
    at = place[owner]
    moved = at >= 0
    now = distance.copy()
    now[moved] = near[np.flatnonzero(moved), at[moved]]
    anew = (owner < 0) | (distance < 0) | moved & (now > distance)
    best = near.argmin(axis=1)
    rival, least = changed[best], near[np.arange(len(near)), best]
    wins = (least < now) | (least == now) & (rival < owner)
    out, dist = np.where(wins, rival, owner), np.where(wins, least, now)
    if anew.any():
        every = squares(vectors[anew], centroids)
        first = every.argmin(axis=1)
        out[anew] = first
        if every.dtype == object:  # large components may be in centroids that did not change
            dist = dist.astype(object)
        dist[anew] = every[np.arange(len(every)), first]
    return out, dist


class Transfers:
    """Signed counts and sums of the vectors that a task moved between clusters; as large as the clusters, whatever the rows."""

    def __init__(self, clusters: int, dims: int):
        self.count = [0] * clusters
        self.sums = np.zeros((clusters, dims), object)

    def add(self, vectors: np.ndarray, owner: np.ndarray, sign: int) -> None:
        small = np.abs(vectors).max(initial=0) < EXACT
        for c in np.unique(owner[owner >= 0]).tolist():
            mine = vectors[owner == c]
            self.count[c] += sign * len(mine)
            self.sums[c] += sign * (mine.sum(axis=0) if small else mine.astype(object).sum(axis=0)).astype(object)

    def touched(self) -> list[int]:
        return [c for c, n in enumerate(self.count) if n or self.sums[c].any()]


def state_schema(id_type: T.DataType) -> T.StructType:
    """A vector (id, vector, cluster, distance) or a transfer (cluster, moved, sums)."""
    return T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("vector", VECTOR),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
            T.StructField("moved", T.LongType()),
            T.StructField("sums", T.ArrayType(SUMS, False)),
        ]
    )


def lists_of(rows: np.ndarray) -> pa.ListArray:
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32)), pa.array(rows.reshape(-1)), type=to_arrow_type(VECTOR))


def assigned(df: DataFrame, id_type: T.DataType, centroids: Sequence[Sequence[int]], changed: Sequence[int], dims: int) -> DataFrame:
    """The next state of ``id, vector, cluster, distance`` (the last two null where there is none yet), and the transfers that lead to it."""
    schema = state_schema(id_type)
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, which = np.array(centroids, np.int64).reshape(-1, dims), np.array(changed)
        transfers = Transfers(len(c), dims)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            owner, distance = (b.column(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            now, dist = reassign(v, owner, distance, c, which)
            gone = now != owner
            transfers.add(v[gone], owner[gone], -1)
            transfers.add(v[gone], now[gone], 1)
            n = b.num_rows
            # what no long can hold is null
            dists = pa.array(dist) if dist.dtype != object else pa.array([d if d <= MOST else None for d in dist], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lists_of(v), pa.array(now, pa.int32()), dists, pa.nulls(n, types[4]), pa.nulls(n, types[5])], names=schema.names)
        if touched := transfers.touched():
            n = len(touched)
            sums = pa.array([[Decimal(int(x)) for x in transfers.sums[k]] for k in touched], types[5])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.array(touched, pa.int32()), pa.nulls(n, types[3]), pa.array([transfers.count[k] for k in touched], pa.int64()), sums], names=schema.names)

    return df.select("id", "vector", "cluster", "distance").mapInArrow(run, schema)


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, vector`` of the rows whose vector has ``dims`` components, none null or non-finite, as integers."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("vector", VECTOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, v = integers(b.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)), lists_of(v)], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, schema)


def summed(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums) of the state's transfers; at most a row per cluster and component comes to the driver."""
    moves = state.where(F.col("moved").isNotNull())
    parts = moves.select("cluster", "moved", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("moved").alias("n"), F.sum("x").alias("x")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts:
        found.setdefault(r.cluster, (r.n, [0] * dims))[1][r.i] = int(r.x)
    return [(c, n, sums) for c, (n, sums) in sorted(found.items())]


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, list[list[int]]]:
    """``id_col, cluster, distance`` of every kept vector, and the final centroids, as delta Lloyd rounds give them.

    Centroids start as the kept vectors whose salted ids have the smallest sha256 (a null id counts as the empty text; of equal ids the
    smaller vector comes first); with fewer vectors there are fewer. Each round assigns all vectors, then moves every non-empty centroid to the floor of its
    vectors' mean; at last they are assigned once more. Vectors of another length, null ones and those with null or non-finite
    components are left out; every other row, repeated ones too, gives one row. Components beyond 2**62 either way count as that; a distance that no long holds is null.
    Other columns are not read. Without kept vectors the result is empty and there are no centroids.
    """
    spark = df.sparkSession
    bound_batches(spark)
    id_type = df.schema[id_col].dataType
    kept = kept_vectors(df, id_col, vector_col, dims, scale)
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.vector) for r in kept.select("vector", key.alias("key")).orderBy("key", "vector").limit(clusters).collect()]
    folder = scratch_folder(spark, "centroids")
    if not centroids:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []

    def step(source: DataFrame, changed: list[int], number: int) -> DataFrame:
        assigned(source, id_type, centroids, changed, dims).write.parquet(f"{folder}/{number}")
        return spark.read.schema(state_schema(id_type)).parquet(f"{folder}/{number}")

    state = step(kept.select("id", "vector", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), list(range(len(centroids))), 0)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    for number in range(1, rounds + 1):
        for c, n, moved in summed(state, dims):
            counts[c] += n
            sums[c] = [x + y for x, y in zip(sums[c], moved, strict=True)]
        means = [[x // n for x in s] if n else old for n, s, old in zip(counts, sums, centroids, strict=True)]
        changed = [c for c, (new, old) in enumerate(zip(means, centroids, strict=True)) if new != old]
        if not changed:
            break
        centroids = means
        state = step(state.where(F.col("moved").isNull()), changed, number)
        remove_folder(spark, f"{folder}/{number - 1}")
    return state.where(F.col("moved").isNull()).select(F.col("id").alias(id_col), "cluster", "distance"), centroids


def with_inertia(found: DataFrame, centroids: Sequence[Sequence[int]]) -> DataFrame:
    """``cluster_inertia, inertia, centroid_sha256`` beside the rows of ``cluster``; sums that no long holds, or over a null distance, are null."""
    rows = {r.cluster: (int(r.d) if r.d is not None and r.n == r.known else None) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(SUMS)).alias("d"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known")).collect()}
    total = None if None in rows.values() else sum(rows.values())
    held = lambda x: F.lit(x if x is not None and x <= MOST else None).cast("long")
    if not centroids:
        return found.select("*", held(None).alias("cluster_inertia"), held(None).alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        "*",
        F.array(*[held(rows.get(c, 0)) for c in range(len(centroids))])[F.col("cluster")].alias("cluster_inertia"),
        held(total).alias("inertia"),
        F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"),
    )


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings`` with inertia and digests of centroids; nulls, odd vectors, ties, repeated rows and empty tables as in cluster."""
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """All rounds, written out."""
    square = "list_sum(list_transform(list_zip(v.x, {c}.m), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::HUGEINT))"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x AS m FROM v QUALIFY c < 8)",
    ]
    for i in range(ROUNDS + 1):
        c = f"c{i}"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {square.format(c=c)}, 'c': c}}) AS b FROM v, {c} GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT b.c AS c, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{i} JOIN v USING (r))")
            parts.append(f"f{i} AS (SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n FROM s{i} GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM f{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.m, {c}.m) AS m FROM {c} LEFT JOIN m{i} USING (c))")
    last = f"c{ROUNDS}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b.c::INTEGER AS cluster, b.d::BIGINT AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string({last}.m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN {last} ON {last}.c = b.c"""


QUERIES = {"op12_delta_lloyd": op12_delta_lloyd}
ORACLES = {"op12_delta_lloyd": _sql()}
