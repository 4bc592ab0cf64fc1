"""Average precision of permuted features, from rows packed into a few bytes.

A model sees a row only through the thresholds it is above, so a row travels as its codes (eight features a number; the
values themselves where a model has no thresholds).  Rows are dealt into ranges of a seeded hash and sorted there; each
takes the values of its successor, the last of a range those of the next range's first.  A task scores all variants of
its rows and hands out sorted distinct scores with their counts, cut into ranges of scores.  Each range is merged in one
task; what lies above it comes from the ranges' totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import quoted
from flowspark.functions.hashing import hash_number, row_hash
from flowspark.functions.sequence import quantile_edges
from flowspark.operators import trees
from flowspark.session import discard, materialize, ship_package

RANGE_ROWS = 500_000
CHUNK_ROWS = 1 << 17  # rows of which all variants are scored at a time
HEAD, TAIL = -1, -2  # of a range of hashes: in place of a variant's number
COUNTED = "variant int, range int, scores binary, pos binary, rows binary"


class Packing(NamedTuple):
    """How the features of a row become whole numbers; without ``edges`` they are the bits of the values."""

    features: int
    edges: list[np.ndarray] | None

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(self.features if self.edges is None else -(-self.features // 8))]

    def pack(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return np.ascontiguousarray(x, float).view(np.int64)
        codes = np.zeros((len(x), 8 * len(self.words)), np.uint8)
        for f, e in enumerate(self.edges):
            codes[:, f] = np.searchsorted(e, x[:, f], side="left")
        return codes.view("<i8")

    def unpack(self, words: np.ndarray) -> np.ndarray:
        """Values that a model takes for those packed: of a code the upper edge."""
        if self.edges is None:
            return words.view(float)
        codes = np.ascontiguousarray(words).view(np.uint8)
        return np.stack([np.append(e, np.inf)[codes[:, f]] for f, e in enumerate(self.edges)], axis=1)


def packing(model) -> Packing:
    features, fitted = len(model.features), model.fitted
    if not isinstance(fitted, trees.Ensemble):
        return Packing(features, None)
    inner = fitted.low != np.arange(len(fitted.low))
    edges = [np.unique(fitted.threshold[inner & (fitted.feature == f)]) for f in range(features)]
    return Packing(features, edges if max(map(len, edges), default=0) < 256 else None)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first all lowest bytes, which differ, last all highest, which are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _kept(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted scores as the steps between their bits; most counts are 1 in all."""
    return _planes(np.diff(scores.view(np.int64), prepend=np.int64(0))), _planes(pos), _planes(pos + neg)


def _read(scores: bytes, pos: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = _unplaned(pos)
    return np.cumsum(_unplaned(scores)).view(float), pos, _unplaned(rows) - pos


def _merged(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores upwards with their counts; a score that is no number is none."""
    there = ~np.isnan(scores)
    if not there.all():
        scores, pos, neg = scores[there], pos[there], neg[there]
    order = np.argsort(scores, kind="stable")
    scores, pos, neg = scores[order], pos[order], neg[order]
    start = np.flatnonzero(np.append(True, scores[1:] != scores[:-1])) if len(scores) else np.zeros(0, np.int64)
    return scores[start], *(np.add.reduceat(c, start) if len(start) else c[:0] for c in (pos, neg))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in COUNTED.split(", ")])


def _counted(variant: int, scores: np.ndarray, labels: np.ndarray, edges: np.ndarray) -> list[tuple]:
    """A row for each range of scores that occurs."""
    ones = (labels == 1).astype(np.int64)
    scores, pos, neg = _merged(scores, ones, 1 - ones)
    where = np.searchsorted(edges, scores, side="right")
    cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
    return [(variant, int(where[a]), *_kept(scores[a:z], pos[a:z], neg[a:z])) for a, z in zip(cuts, [*cuts[1:], len(where)])]


def _parts(parts: Sequence[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _merged(*(np.concatenate(c) for c in zip(*(_read(*p) for p in parts))))


def _merge(table: pa.Table) -> pa.Table:
    columns = [c.split()[0] for c in COUNTED.split(", ")]
    variant, at = (table.column(c)[0].as_py() for c in columns[:2])
    if variant < 0 or table.num_rows == 1:
        return table.select(columns)
    return pa.Table.from_batches([_rows([(variant, at, *_kept(*_parts(list(zip(*(table.column(c).to_pylist() for c in columns[2:]))))))])])


def precisions(counted: DataFrame, name: str, finish=None) -> dict[int, float | None]:
    """Average precision of each variant; ``finish`` makes rows that were not counted from the heads and tails."""
    stored = materialize(counted.groupBy("variant", "range").applyInArrow(_merge, COUNTED), name)
    more: dict[tuple[int, int], list[tuple]] = {}
    for row in finish(stored.where("variant < 0").collect()) if finish else ():
        more.setdefault(row[:2], []).append(row[2:])

    def whole(batches):
        for b in batches:
            for r in b.to_pylist():
                own = [(r["scores"], r["pos"], r["rows"]), *more.get((r["variant"], r["range"]), ())]
                yield r["variant"], r["range"], *_parts(own)

    def totals(batches):
        for variant, at, _, pos, neg in whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (variant, at, int(pos.sum(dtype=np.int64)), int(neg.sum(dtype=np.int64)))], ["variant", "range", "pos", "neg"])

    there = stored.where("variant >= 0")
    # A range that only the driver's rows reach has no row of its own.
    seen = {(r.variant, r.range) for r in there.select("variant", "range").collect()} if more else set()
    lone = [(*k, b"", b"", b"") for k in more if k not in seen]
    if lone:
        there = there.unionByName(stored.sparkSession.createDataFrame(pa.Table.from_batches([_rows(lone)])))
    found = {(r.variant, r.range): (r.pos, r.neg) for r in there.mapInArrow(totals, "variant long, range long, pos long, neg long").collect()}
    above, running = {}, {}
    for variant, at in sorted(found, key=lambda k: (k[0], -k[1])):
        above[variant, at] = running.get(variant, (0, 0))
        running[variant] = tuple(a + n for a, n in zip(above[variant, at], found[variant, at]))

    def areas(batches):
        for variant, at, _, pos, neg in whole(batches):
            p, n = above[variant, at]
            ps, ns = p + np.cumsum(pos[::-1], dtype=np.int64), n + np.cumsum(neg[::-1], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (variant, float((pos[::-1] * (ps / (ps + ns))).sum()))], ["variant", "area"])

    sums: dict[int, list[float]] = {}
    for r in there.mapInArrow(areas, "variant long, area double").collect():
        sums.setdefault(r.variant, []).append(r.area)
    discard(stored)
    return {v: sum(sorted(sums[v])) / p if p else None for v, (p, _) in running.items()}


def permuted_precisions(df: DataFrame, model, label: str, row_id: str, repeats: int, seed: int) -> tuple[float, list[tuple[str, int, float]]]:
    """Average precision of the rows as they are, and by feature and repeat with the feature's values of other rows."""
    spark, boosted = df.sparkSession, model.kind == "gbt"
    ship_package(spark)
    how = packing(model)
    words, names = how.words, [f"x{i}" for i in range(how.features)]
    shared = spark.sparkContext.broadcast(trees.Scorer(model.fitted) if isinstance(model.fitted, trees.Ensemble) else model.fitted)

    def score(machine, x: np.ndarray) -> np.ndarray:
        if not isinstance(machine, trees.Scorer):
            return machine.probability(x)
        total = machine.total(x)
        return 1 / (1 + np.exp(-machine.model.base - total)) if boosted else total / len(machine.model.roots)

    def packed(batches):
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)
            own = how.pack(x)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(score(shared.value, how.unpack(own)), from_pandas=True), *(pa.array(np.ascontiguousarray(w)) for w in own.T)], ["_id", "_y", "_score", *words])

    rows = df.select(quoted(row_id).cast("string").alias("_id"), quoted(label).cast("int").alias("_y"), *[quoted(f).cast("double").alias(n) for f, n in zip(model.features, names)])
    base = materialize(rows.mapInArrow(packed, ", ".join(["_id string", "_y int", "_score double", *(f"{w} long" for w in words)])), "permuted")
    edges = np.array(quantile_edges(base, "_score", RANGE_ROWS))

    def plain(batches):
        for b in batches:
            found = _counted(0, b.column("_score").to_numpy(zero_copy_only=False), b.column("_y").to_numpy(), edges)
            if found:
                yield _rows(found)

    baseline = precisions(base.select("_score", "_y").mapInArrow(plain, COUNTED), "plain-scores").get(0)
    ranges = max(1, -(-base.count() // RANGE_ROWS))

    def variants(own: np.ndarray, donors: np.ndarray, labels: np.ndarray, machine) -> list[tuple]:
        x, other, out = how.unpack(own), how.unpack(donors), []
        for f in range(how.features):
            changed = x.copy()
            changed[:, f] = other[:, f]
            out += _counted(f, score(machine, changed), labels, edges)
        return out

    def scored(batches):
        """Heads and tails of the ranges of hashes as they are, all other rows as counted scores."""
        machine, held, size = shared.value, [], 0

        def flushed(end: bool):
            nonlocal held, size
            x = np.concatenate(held)
            last = np.append(x[1:, 0] != x[:-1, 0], True)
            first = np.append(True, x[1:, 0] != x[:-1, 0])
            first[0] &= starts
            marks = [(kind, int(x[i, 0]), x[i, 2:].tobytes(), b"", b"") for kind, at in ((HEAD, first), (TAIL, last & (np.arange(len(x)) < len(x) - (not end)))) for i in np.flatnonzero(at)]
            inside = np.flatnonzero(~last)
            out = marks + (variants(x[inside, 2:-1], x[inside + 1, 2:-1], x[inside, -1], machine) if len(inside) else [])
            # The last row waits for its successor.
            held, size = [x[-1:]], 1
            return out

        starts = True
        for b in batches:
            held.append(np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(b.num_columns)], axis=1))
            size += b.num_rows
            if size > CHUNK_ROWS:
                out = flushed(False)
                starts = False
                if out:
                    yield _rows(out)
        if held and size:
            out = flushed(True)
            if out:
                yield _rows(out)

    def finish(ends: Sequence) -> list[tuple]:
        """Counted rows of the ranges' last rows, which take the values of the next ranges' first."""
        at = {kind: {r["range"]: np.frombuffer(r["scores"], np.int64) for r in ends if r["variant"] == kind} for kind in (HEAD, TAIL)}
        order = sorted(at[TAIL])
        if not order:
            return []
        own = np.stack([at[TAIL][r] for r in order])
        donors = np.stack([at[HEAD][r] for r in [*order[1:], order[0]]])
        return variants(np.ascontiguousarray(own[:, :-1]), np.ascontiguousarray(donors[:, :-1]), own[:, -1], shared.value)

    results = []
    for k in range(repeats):
        h = F.coalesce(hash_number(row_hash(F.col("_id"), seed + k)), F.lit(-1))
        keyed = base.select(h.alias("_h"), *words, F.col("_y").cast("long").alias("_y"))
        keyed = keyed.select(F.expr(f"shiftright(shiftright(_h, 30) * {ranges}, 30)").cast("long").alias("_range"), "_h", *words, "_y")
        ordered = keyed.repartition("_range").sortWithinPartitions("_range", "_h", *words, "_y")
        found = precisions(ordered.mapInArrow(scored, COUNTED), "permuted-scores", finish)
        results += [(model.features[f], k, found.get(f)) for f in range(how.features)]
    shared.destroy()
    discard(base)
    return baseline, results
