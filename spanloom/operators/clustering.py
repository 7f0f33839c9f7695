"""k-means with seeding and restarts for many groups at once, and spectral clustering of voices over sparse neighbour graphs.

No group meets in one task. Points lie in blocks of a bounded number of rows; a round of k-means joins blocks and centres by
group and adds up what the blocks found. The graph of a group is a table of edges, and all that the spectrum needs is
products of that table with a few columns, each a join and a sum; what is gathered per group are matrices of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialized

#: Rows of a block: what one call holds.
BLOCK = 2048
RESTARTS = 8
ROUNDS = 60
SEED = 17
#: Neighbours a row keeps at most, itself included; up to some five hundred rows the group's size decides.
NEIGHBOURS = 64
MOST_SPEAKERS = 8
#: Columns of the block that is multiplied, and how often: their products span groups of no more rows than the one times the other.
WIDTH = 12
POWERS = 6


def dealt(df: DataFrame, group: str, row_id: str, block: int) -> DataFrame:
    """Adds ``__n``, the rows of the group, and ``__b``, one of as many blocks as hold ``block`` rows on average."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(sizes, group).withColumn("__b", F.pmod(F.xxhash64(row_id), F.ceil(F.col("__n") / block)).cast("int"))


def drawn(ids: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the ids and salts alone."""
    x = ids.astype(np.uint64)
    for s in (*salts, SEED):
        x = (x ^ np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (point, centre), never below zero."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def summed(parts: DataFrame, group: str, value: str) -> DataFrame:
    """group, i, value: arrays of one length added up by place, before the shuffle and after."""
    return parts.select(group, F.posexplode(value).alias("i", "v")).groupBy(group, "i").agg(F.sum("v").alias("v"))


def gathered(cells: DataFrame, group: str) -> DataFrame:
    """group, value: the cells of each group as an array again; of a fixed size by what was summed."""
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("value"))


def kmeans(df: DataFrame, group: str, row_id: str, vector: str, k: int | Column, restarts: int = RESTARTS, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """group, id, cluster (from 0), inertia: k-means of every group's vectors, the best of ``restarts`` seedings by inertia, ties to the earlier one.

    Seeds are drawn one after another with a chance that follows the squared distance to those before: each row draws an exponential
    time by a hash of its id (a long), and the earliest wins, so that a draw is one minimum. Then rounds of assignment and means run until no centre
    moves; an empty cluster keeps its centre. ``k`` may be a column that is constant within a group; k of 1 or fewer gives one cluster, and groups of no more than
    k rows give each row its own. Rows with null vectors go; vectors of a group have one length. Repeated ids are separate rows of one draw.
    """
    spark = df.sparkSession
    points = dealt(df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.greatest(k if isinstance(k, Column) else F.lit(k), F.lit(1)).cast("int").alias("k")), "g", "id", block)
    trivial = points.where((F.col("k") <= 1) | (F.col("__n") <= F.col("k")))
    own = F.when(F.col("k") > 1, F.row_number().over(W.partitionBy("g").orderBy("id", "x")) - 1).otherwise(0)
    few = trivial.where("k > 1").select("g", "id", own.cast("int").alias("cluster"), F.lit(0.0).alias("inertia"))
    ones = trivial.where("k <= 1").select("g", "id", F.lit(0).alias("cluster"), F.lit(None).cast("double").alias("inertia"))
    kind = df.schema[group].dataType.simpleString()
    held = points.where((F.col("k") > 1) & (F.col("__n") > F.col("k"))).groupBy("g", "__b").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"), F.max("k").alias("k"))
    blocks = materialized(held)

    def read(row) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(row.ids, np.int64)
        return ids, np.asarray(row.xs, float).reshape(len(ids), -1)

    def seeding(step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples():
                    ids, x = read(row)
                    if step >= row.k:
                        continue
                    for r in range(restarts):
                        time = -np.log(drawn(ids, r, step))
                        if step:
                            centres = np.asarray(row.centres[r], float).reshape(step, -1)
                            far = squares(x, centres).min(1)
                            with np.errstate(divide="ignore"):
                                # where all rows lie on centres, any row may come
                                time = np.where(far > 1e-12, time / far, 1e300 + time)
                        best = int(time.argmin())
                        out.append((row.g, r, float(time[best]), x[best].tolist()))
                yield pd.DataFrame(out, columns=["g", "r", "time", "x"])

        return run

    centres = None
    deepest = blocks.agg(F.max("k")).first()[0] or 0
    for step in range(deepest):
        given = blocks if step == 0 else blocks.join(centres, "g")
        found = given.mapInPandas(seeding(step), f"g {kind}, r int, time double, x array<double>").groupBy("g", "r").agg(F.min_by("x", F.struct("time", "x")).alias("x"))
        new = found.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda c: c["x"]).alias("new"))
        if step == 0:
            centres = new.withColumnRenamed("new", "centres")
        else:
            # groups that have all their seeds get none; the others append one to each restart
            centres = centres.join(new, "g", "left").select("g", F.when(F.col("new").isNull(), F.col("centres")).otherwise(F.zip_with("centres", "new", lambda a, b: F.concat(a, b))).alias("centres"))
        centres = materialized(centres)

    def lloyd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                _, x = read(row)
                sums = []
                for flat in row.centres:
                    c = np.asarray(flat, float).reshape(row.k, -1)
                    d = squares(x, c)
                    near = d.argmin(1)
                    hot = np.eye(row.k)[near]
                    sums.append(np.concatenate([np.column_stack([hot.sum(0), hot.T @ x]).ravel(), [d[np.arange(len(x)), near].sum()]]))
                out.append((row.g, np.concatenate(sums).tolist()))
            yield pd.DataFrame(out, columns=["g", "part"])

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                new, inertia, same = [], [], True
                for flat, part in zip(row.centres, np.asarray(row.value, float).reshape(restarts, -1), strict=True):
                    c = np.asarray(flat, float).reshape(row.k, -1)
                    s = part[:-1].reshape(row.k, -1)
                    means = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), c)
                    same &= bool(np.allclose(means, c, rtol=0, atol=1e-12))
                    new.append(means.ravel().tolist())
                    inertia.append(float(part[-1]))
                out.append((row.g, new, inertia, same))
            yield pd.DataFrame(out, columns=["g", "centres", "inertia", "same"])

    ks = blocks.groupBy("g").agg(F.max("k").alias("k"))
    best = None
    for _ in range(rounds if deepest else 0):
        parts = blocks.join(centres.select("g", "centres"), "g").mapInPandas(lloyd, f"g {kind}, part array<double>")
        whole = gathered(summed(parts, "g", "part"), "g").join(centres.select("g", "centres"), "g").join(ks, "g")
        centres = best = materialized(whole.mapInPandas(moved, f"g {kind}, centres array<array<double>>, inertia array<double>, same boolean"))
        if best.where(~F.col("same")).isEmpty():
            break
    if best is None:
        return few.unionByName(ones).select(F.col("g").alias(group), F.col("id").alias(row_id), "cluster", "inertia")
    # inertias that differ by rounding alone are equal
    rounded = F.transform("inertia", lambda v: F.round(v, 9))
    pick = best.withColumn("__r", F.array_position(rounded, F.array_min(rounded)).cast("int")).select("g", F.element_at("centres", F.col("__r")).alias("centre"), F.element_at("inertia", F.col("__r")).alias("inertia"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, x = read(row)
                yield pd.DataFrame({"g": row.g, "id": ids, "cluster": squares(x, np.asarray(row.centre, float).reshape(row.k, -1)).argmin(1), "inertia": row.inertia})

    many = blocks.join(pick, "g").mapInPandas(label, f"g {kind}, id long, cluster int, inertia double")
    return many.unionByName(few).unionByName(ones).select(F.col("g").alias(group), F.col("id").alias(row_id), "cluster", "inertia")


def unit(v: Column) -> Column:
    """The array at length one; a null one stays null."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-9)))


def centred(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The vectors of each group of more than two rows less their common part: unit length, minus the group's mean, unit length again."""
    ones = df.withColumn(vector, unit(F.col(vector).cast("array<double>")))
    mean = gathered(ones.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("v")), group)
    sized = mean.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), group)
    away = unit(F.zip_with(vector, "value", lambda a, b: a - b))
    return ones.join(sized, group).withColumn(vector, F.when(F.col("__n") > 2, away).otherwise(F.col(vector))).drop("value", "__n")


def kept_neighbours(n: Column, speakers: int, most: int) -> Column:
    """How many neighbours a row of a group of n keeps, itself included: about one cluster's worth, all in groups of up to three."""
    share = F.rint(n / F.greatest(F.lit(2), F.least(F.lit(speakers), n - 1))).cast("int") + 1
    return F.when(n > 3, F.least(F.greatest(F.lit(2), F.least(n - 1, share)), F.lit(most))).otherwise(n).cast("int")


def neighbour_graph(df: DataFrame, group: str, row_id: str, vector: str, speakers: int = MOST_SPEAKERS, most: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """g, i, j, w: symmetric affinities, (1 + cosine) / 2 where the one keeps the other among its nearest and half of it where one side does.

    Vectors have unit length. Blocks of rows meet in pairs within their group, and each pair keeps what a row needs. Equal cosines go by a hash of both ids, so that many
    equal vectors link to different ones and not all to the same few.
    """
    points = dealt(df.select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(vector).alias("x")), "g", "id", block).withColumn("keep", kept_neighbours(F.col("__n"), speakers, most))
    last = (F.ceil(F.col("__n") / block) - 1).cast("int")
    a = points.select("g", F.col("__b").alias("p"), F.explode(F.sequence(F.lit(0), last)).alias("q"), "id", "x", "keep")
    b = points.select(F.col("g").alias("h"), F.col("__b").alias("q"), F.explode(F.sequence(F.lit(0), last)).alias("p"), F.col("id").alias("other"), F.col("x").alias("y"))
    kind = df.schema[group].dataType.simpleString()

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "i": [], "j": [], "a": [], "keep": []})
        i, j, keep = left["id"].to_numpy(), right["other"].to_numpy(), int(left["keep"].iloc[0])
        cos = np.round(np.stack(left["x"].to_numpy()) @ np.stack(right["y"].to_numpy()).T, 9)
        cos[i[:, None] == j[None, :]] = 1.0
        m = min(keep, len(j))
        # the row itself first, then by cosine, then by hash
        order = np.lexsort((drawn(i[:, None] * 31 + j[None, :], 1), -cos, i[:, None] != j[None, :]), axis=1)[:, :m]
        rows = np.repeat(np.arange(len(i)), m)
        cols = order.ravel()
        return pd.DataFrame({"g": left["g"].iloc[0], "i": i[rows], "j": j[cols], "a": (1 + cos[rows, cols]) / 2, "keep": keep})

    met = a.groupBy("g", "p", "q").cogroup(b.groupBy("h", "p", "q")).applyInPandas(near, f"g {kind}, i long, j long, a double, keep int")
    place = F.row_number().over(W.partitionBy("g", "i").orderBy(F.col("i") != F.col("j"), F.desc("a"), F.xxhash64("i", "j"), "j"))
    kept = met.withColumn("k", place).where("k <= keep").select("g", "i", "j", (F.col("a") / 2).alias("w"))
    return kept.unionByName(kept.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("g", "i", "j").agg(F.sum("w").alias("w"))


def spectrum(graph: DataFrame, limit: int = MOST_SPEAKERS, width: int = WIDTH, powers: int = POWERS) -> tuple[DataFrame, DataFrame]:
    """(g, i, f) and (g, k, values): what the smallest eigenvalues of each group's normalised Laplacian say.

    ``graph`` is squared as it is used (a step of diffusion): two products, never the square itself. ``values`` are the smallest eigenvalues, k their count up to the
    widest gap among the first ``limit``, f the row's place in the first k eigenvectors at unit length. A block of ``width`` columns that hashes fill is multiplied
    ``powers`` times by a join and a sum each; the best vectors within all the products (Rayleigh and Ritz) come from one matrix per group of products of columns with each other.
    """
    graph = materialized(graph)
    kind = graph.schema["g"].dataType.simpleString()

    def product(edges: DataFrame, x: DataFrame, cols: list[str], weight: Column) -> DataFrame:
        return edges.join(x.withColumnRenamed("i", "j"), ["g", "j"]).groupBy("g", "i").agg(*[F.sum(F.col(c) * weight).alias(c) for c in cols])

    ones = graph.groupBy("g", "i").agg(F.sum("w").alias("x0"))
    root = product(graph, ones, ["x0"], F.col("w")).select("g", "i", (1 / F.sqrt(F.greatest("x0", F.lit(1e-9)))).alias("s"))
    root = materialized(root)
    edges = materialized(graph.join(root.withColumnRenamed("s", "si"), ["g", "i"]).join(root.select("g", F.col("i").alias("j"), F.col("s").alias("sj")), ["g", "j"]))
    cols = [f"x{c}" for c in range(width)]
    # a fixed block of plain pseudo-random numbers around zero
    x = root.select("g", "i", *[(F.pmod(F.xxhash64(F.lit(SEED + c), F.col("i")), F.lit(1 << 20)) / (1 << 19) - 1).alias(f"x{c}") for c in range(width)])
    basis = x.select("g", "i", F.array(*cols).alias("y0"))
    for t in range(1, powers + 1):
        x = materialized(product(edges, product(edges, x, cols, F.col("w") * F.col("sj")), cols, F.col("w") * F.col("si")))
        basis = basis.join(x.select("g", "i", F.array(*cols).alias(f"y{t}")), ["g", "i"])
    rows = materialized(basis.select("g", "i", F.concat(*[f"y{t}" for t in range(powers + 1)]).alias("y")))
    size = (powers + 1) * width

    def grams(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        y = np.stack(block["y"].to_numpy())
        return pd.DataFrame({"g": [key[0]], "n": [len(y)], "gram": [(y.T @ y).ravel().tolist()]})

    blocked = dealt(rows, "g", "i", BLOCK)
    parts = blocked.groupBy("g", "__b").applyInPandas(grams, f"g {kind}, n long, gram array<double>")
    whole = gathered(summed(parts, "g", "gram"), "g").join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                gram = np.asarray(row.value, float).reshape(size, size)
                scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
                gram = gram * scale[:, None] * scale[None, :]
                inner, cross = gram[:-width, :-width], gram[:-width, width:] * (scale[:-width] / scale[width:])[None, :]
                s, u = np.linalg.eigh((inner + inner.T) / 2)
                good = s > 1e-10 * s[-1]
                b = u[:, good] / np.sqrt(s[good])
                theta, v = np.linalg.eigh(b.T @ ((cross + cross.T) / 2) @ b)
                order = np.argsort(-theta)[: max(1, min(limit + 1, row.n))]
                values = 1 - theta[order]
                top = min(limit, row.n - 1)
                k = 1
                if top >= 2:
                    k = max(1, min(int(np.argmax(np.round(np.diff(values[: top + 1]), 9))) + 1, top))
                weights = np.zeros((size, k))
                weights[:-width] = (b @ v[:, order[:k]]) * scale[:-width, None]
                out.append((row.g, k, values.tolist(), weights.T.ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "k", "values", "weights"])

    found = materialized(whole.mapInPandas(solved, f"g {kind}, k int, values array<double>, weights array<double>"))

    def placed(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        weights = np.asarray(block["weights"].iloc[0], float).reshape(-1, size)
        f = np.stack(block["y"].to_numpy()) @ weights.T
        f /= np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)
        return pd.DataFrame({"g": key[0], "i": block["i"], "f": list(f)})

    places = blocked.join(found.select("g", "weights"), "g").groupBy("g", "__b").applyInPandas(placed, f"g {kind}, i long, f array<double>")
    return places, found.select("g", "k", "values")


def speakers(df: DataFrame, group: str, row_id: str, vector: str, most: int = MOST_SPEAKERS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """group, id, speaker, confidence, speakers: voices told apart within each recording.

    The number of speakers is where the spectrum's gap is widest, at most ``most``; rows join the nearest of so many centres in the spectrum. Names are SPEAKER_00 and so on
    in the order of first rows (by id, a long that is unique in its group). Confidence is (1 + cosine to the mean vector of the speaker) / 2. Rows with null vectors go; a single row is one speaker.
    """
    rows = materialized(centred(df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("i"), F.col(vector).alias("x")), "g", "x"))
    places, found = spectrum(neighbour_graph(rows, "g", "i", "x", most, neighbours), most)
    labels = kmeans(places.join(found, "g"), "g", "i", "f", F.col("k"))
    firsts = labels.groupBy("g", "cluster").agg(F.min("i").alias("first"))
    named = firsts.withColumn("__k", F.row_number().over(W.partitionBy("g").orderBy("first")) - 1).withColumn("speakers", F.count(F.lit(1)).over(W.partitionBy("g")).cast("int"))
    told = labels.join(named, ["g", "cluster"]).join(rows, ["g", "i"])
    means = told.select("g", "cluster", F.posexplode("x").alias("p", "v")).groupBy("g", "cluster", "p").agg(F.avg("v").alias("v"))
    means = means.groupBy("g", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda c: c["v"]).alias("mean"))
    dot = F.aggregate(F.zip_with("x", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = told.join(means, ["g", "cluster"])
    name = F.format_string("SPEAKER_%02d", F.col("__k").cast("int"))
    return out.select(F.col("g").alias(group), F.col("i").alias(row_id), name.alias("speaker"), F.round(F.least(F.greatest((dot + 1) / 2, F.lit(0.0)), F.lit(1.0)), 4).alias("confidence"), "speakers")
