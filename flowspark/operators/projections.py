"""Near neighbours in many dimensions, from trees of random projections.

A tree halves the points again and again at the median of their projection on the line
through two of them, down to leaves of bounded size; a point meets the members of its
leaf in every tree.  What a point costs is therefore the number of trees times the size
of a leaf, whatever the number of points or of dimensions.  Trees are added until the
recall, measured against brute force for some of the queries, is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import materialize, scratch_path, ship_package
from flowspark.sources.files import delete

TREES = 8  # grown at a time
MAX_TREES = 64
LEAF_POINTS = 1_000
MAX_CELLS = 2_048  # leaves of a tree that the driver fits; tasks halve them further
SAMPLE_PER_CELL = 32
CELL_POINTS = 100_000  # of one cell in one task
CHECKED = 200  # queries that are answered by brute force, to measure the recall
RECALL = 0.95

FOUND = "_pid bigint, _n bigint, _d double, _m bigint"


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def halve(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(direction, cut, rows on the low side), or None if the points cannot be told apart."""
    first, second = rng.choice(len(x), 2, replace=False)
    direction = x[first] - x[second]
    length = np.sqrt((direction**2).sum())
    if not 0 < length < np.inf:
        return None
    direction = direction / length
    place = x @ direction
    cut = float(np.median(place))
    if cut == place.max():
        below = place[place < cut]
        if not len(below):
            return None
        cut = float(below.max())
    return direction, cut, place <= cut


def fit_tree(sample: np.ndarray, cells: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, cuts, children) of the inner nodes; children below zero are cells, -1 - number."""
    directions, cuts, children = [], [], []
    leaves = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        parts = halve(rows, rng) if wanted > 1 and len(rows) > 1 else None
        if parts is None:
            leaves += 1
            return -leaves
        here = len(cuts)
        directions.append(parts[0])
        cuts.append(parts[1])
        children.append(None)
        left = grow(rows[parts[2]], wanted // 2)
        children[here] = (left, grow(rows[~parts[2]], wanted - wanted // 2))
        return here

    grow(sample, cells)
    width = sample.shape[1]
    return np.array(directions).reshape(-1, width), np.array(cuts), np.array(children, dtype=np.int64).reshape(-1, 2)


def cell_of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    directions, cuts, children = tree
    at = np.full(len(x), 0 if len(cuts) else -1, dtype=np.int64)
    rows = np.flatnonzero(at >= 0)
    while len(rows):
        node = at[rows]
        high = np.einsum("ij,ij->i", x[rows], directions[node]) > cuts[node]
        at[rows] = children[node, high.astype(np.int64)]
        rows = rows[at[rows] >= 0]
    return -1 - at


def leaves_of(x: np.ndarray, rng: np.random.Generator, limit: int) -> Iterator[np.ndarray]:
    """Row numbers of the points in leaves of at most ``limit``."""
    waiting = [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= limit:
            yield rows
            continue
        parts = halve(x[rows], rng)
        if parts is None:
            waiting += [rows[i : i + limit] for i in range(0, len(rows), limit)]
        else:
            waiting += [rows[parts[2]], rows[~parts[2]]]


def closest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and positions of the ``k`` nearest points, nearest first.

    A product of matrices proposes twice as many; their distances are then taken from the
    differences, so what is reported is not rounded by large coordinates.
    """
    k = min(k, len(points))
    more = min(2 * k, len(points))
    centre = points.mean(axis=0)
    moved = points - centre
    square = (moved**2).sum(axis=1)
    distances, places = [], []
    step = max(1, 4_000_000 // max(len(points), more * points.shape[1]))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        # The query's own square is the same for all points.
        near = np.argpartition(square - 2 * (part - centre) @ moved.T, more - 1, axis=1)[:, :more]
        exact = ((part[:, None, :] - points[near]) ** 2).sum(axis=2)
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        distances.append(np.take_along_axis(exact, order, axis=1))
        places.append(np.take_along_axis(near, order, axis=1))
    if not distances:
        return np.empty((0, k)), np.empty((0, k), dtype=np.int64)
    return np.concatenate(distances), np.concatenate(places)


def pairs(ids: np.ndarray, queries: np.ndarray, points: pd.DataFrame, x: np.ndarray, k: int) -> pd.DataFrame:
    """(_pid, _n, _d, _m) of the nearest points; a point's copies are neighbours, itself is not."""
    squared, near = closest(queries, x, k + 1)
    names = points["_pid"].to_numpy()[near]
    copies = points["_m"].to_numpy()[near] - (names == ids[:, None])
    made = pd.DataFrame(
        {"_pid": np.repeat(ids, near.shape[1]), "_n": names.ravel(), "_d": squared.ravel(), "_m": copies.ravel()}
    )
    return made[made["_m"] > 0]


def _grow(flagged: DataFrame, sample: np.ndarray, cells: int, first: int, k: int, path: str) -> DataFrame:
    """Pairs of queries and points that meet in a leaf of the trees ``first``, ``first + 1``, ...

    ``path`` is where the points are written under their cells; the pairs are computed from there.
    """
    spark = flagged.sparkSession
    trees = [fit_tree(sample, cells, np.random.default_rng(first + t)) for t in range(TREES)]
    shared = spark.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["_x"])
                for number, tree in enumerate(shared.value):
                    yield batch.assign(_tree=first + number, _cell=cell_of(tree, x))

    schema = "_pid bigint, _x array<double>, _m bigint, _q boolean, _tree bigint, _cell bigint"
    flagged.mapInPandas(assign, schema).write.parquet(path)
    shared.destroy()
    placed = spark.read.schema(schema).parquet(path)
    # A cell that outgrows a task is dealt out: that costs recall, which is measured, and no rows.
    lots = placed.groupBy("_tree", "_cell").agg(F.ceil(F.count("*") / CELL_POINTS).alias("_lots"))
    dealt = placed.join(lots, ["_tree", "_cell"]).withColumn("_lot", F.pmod(F.xxhash64("_pid", "_tree"), F.col("_lots")))
    leaf = LEAF_POINTS

    def search(key, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("_pid", ignore_index=True)
        x, asked = matrix(members["_x"]), members["_q"].to_numpy(dtype=bool)
        found = [pd.DataFrame({"_pid": [], "_n": [], "_d": [], "_m": []})]
        for rows in leaves_of(x, np.random.default_rng([int(v) for v in key]), leaf):
            wanted = rows[asked[rows]]
            if len(wanted):
                ids = members["_pid"].to_numpy()[wanted]
                found.append(pairs(ids, x[wanted], members.iloc[rows], x[rows], k))
        return pd.concat(found[1:] or found)

    return dealt.select("_pid", "_x", "_m", "_q", "_tree", "_cell", "_lot").groupBy("_tree", "_cell", "_lot").applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct points of each query; several trees may have found the same."""
    once = found.groupBy("_pid", "_n").agg(F.min("_d").alias("_d"), F.min("_m").alias("_m"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("_d", "_n", "_m"))), 1, k)
    return once.groupBy("_pid").agg(ranked.alias("_near")).select("_pid", F.explode("_near").alias("e")).select(
        "_pid", "e._n", "e._d", "e._m"
    )


def true_radius(points: DataFrame, queries: pd.DataFrame, k: int) -> dict[int, float]:
    """Squared distance of the k-th neighbour of a bounded table of queries, from all points."""
    ids, x = queries["_pid"].to_numpy(), matrix(queries["_x"])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if len(batch):
                found = pairs(ids, x, batch, matrix(batch["_x"]), k)
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values("_d", kind="stable").groupby("_pid").head(k)
        if best is not None:
            yield best

    def radius(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("_d", kind="stable")
        reached = members["_m"].to_numpy().cumsum() >= k
        last = members["_d"].to_numpy()[reached.argmax() if reached.any() else -1]
        return pd.DataFrame({"_pid": members["_pid"].iloc[:1], "_d": [last]})

    table = points.select("_pid", "_x", "_m").mapInPandas(nearest, FOUND)
    return {r["_pid"]: r["_d"] for r in table.groupBy("_pid").applyInPandas(radius, "_pid bigint, _d double").collect()}


def recall_of(best: DataFrame, radius: dict[int, float], k: int) -> float:
    """Share of the true neighbours of the checked queries that were found; equal distances count alike."""
    found = best.where(F.col("_pid").isin(list(radius))).toPandas()
    limit = found["_pid"].map(radius) * (1 + 1e-9)
    hits = found[found["_d"] <= limit].groupby("_pid")["_m"].sum().clip(upper=k)
    return float(hits.sum()) / (k * len(radius))


def forest_neighbours(points: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """(_pid, neighbours) of the points named by ``queries``, or None if the recall stays too low.

    ``points`` is (_pid, _x, _m): distinct vectors and the number of their rows, more than k
    rows in all.  The recall is that of ``CHECKED`` queries, taken in the order of a hash.
    """
    spark = points.sparkSession
    ship_package(spark)
    wanted = queries.select("_pid").distinct().withColumn("_q", F.lit(True))
    flagged = materialize(
        points.select("_pid", "_x", "_m").join(wanted, "_pid", "left").withColumn("_q", F.coalesce("_q", F.lit(False))),
        "flagged",
    )
    total = flagged.count()
    cells = max(1, min(MAX_CELLS, total // LEAF_POINTS))
    size = cells * SAMPLE_PER_CELL
    sample = flagged.select("_x").sample(min(1.0, 2.0 * size / total), 11).limit(4 * size).toPandas()
    if not len(sample):
        sample = flagged.select("_x").limit(1).toPandas()
    checked = flagged.where("_q").orderBy(F.xxhash64("_pid"), "_pid").select("_pid", "_x").limit(CHECKED).toPandas()
    radius = true_radius(flagged, checked, k)
    best, kept = None, None
    for first in range(0, MAX_TREES, TREES):
        leaves, written = scratch_path(spark, "leaves"), scratch_path(spark, "nearest")
        found = _grow(flagged, matrix(sample["_x"]), cells, first, k, leaves)
        _best(found if best is None else best.unionByName(found), k).write.parquet(written)
        best = spark.read.schema(FOUND).parquet(written)
        # What the new table was made of is not needed again.
        for path in filter(None, (leaves, kept)):
            delete(spark, path)
        kept = written
        if recall_of(best, radius, k) >= RECALL:
            vectors = flagged.select(F.col("_pid").alias("_n"), F.col("_x").alias("_v"))
            near = F.array_sort(F.collect_list(F.struct("_d", "_n", "_v", "_m")))
            repeated = F.flatten(F.transform(near, lambda c: F.array_repeat(c["_v"], F.least(c["_m"], F.lit(k)).cast("int"))))
            return best.join(vectors, "_n").groupBy("_pid").agg(F.slice(repeated, 1, k).alias("neighbours"))
    return None
