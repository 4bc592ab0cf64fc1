"""Trees on binned features: second-order boosting and random forests.

Features become codes of at most 256 bins.  Rows of equal codes, label and fold are one row with a count, written once as
blocks; draws are binomial or Poisson numbers of that count, as if each row were drawn alone.  Gains need sums of two
numbers a bin: gradient and Hessian for boosting, weight of class 1 and weight for forests (where the same gain, without
L2, is the decrease of the Gini impurity).  Nodes with more distinct rows than ``LOCAL_ROWS`` are split level by level from
histograms that are summed over all blocks; what hangs below a smaller node is grown in one task from that node's rows
alone.  So a task never holds more than ``LOCAL_ROWS`` rows, and many small fits (folds, candidates, trees) run beside one
another.  A forest of more than ``HELD_NODES`` nodes stays a written table; rows are scored where its trees lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowspark.functions.expr import quoted
from flowspark.session import materialize, ship_package

BINS = 256
BLOCK_ROWS = 1 << 16
LOCAL_ROWS = 1 << 22  # distinct rows of a node from which a task grows all that hangs below: about 120 bytes each
HELD_NODES = 1 << 18  # of a forest that the driver and the workers hold: about 300 bytes each while it is put together
TREES_A_TASK = 4  # of a written forest
REBUILT = 20  # boosted trees after which margins are computed anew from the written blocks
LEAST_GAIN = 1e-10
MOST_SUMS = 1 << 23  # of all nodes of a level that a task keeps for the next
MASK_LEAVES = 64  # of a tree that is scored by masks
KNOWN_ROWS = 1 << 18  # distinct coded rows whose scores a worker remembers

BLOCKS = "block long, n long, codes binary, label binary, fold binary, count binary"
NODES = "fit int, tree int, node long, feature int, cut int, low long, high long, value double, gain double, weight double"
PIECES = "fit int, tree int, node long, block long, n long, codes binary, label binary, count binary"


class Ensemble(NamedTuple):
    """Nodes of all trees, one tree after another; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray  # at most this goes to ``low``
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    depth: int
    base: float  # what all trees' values are added to

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for rows of features."""
        return self.walked(x, self.roots)

    def walked(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(x)), 1 << 13  # rows whose arrays stay in a core's cache
        for first in range(0, len(x), step):
            part = np.ascontiguousarray(x[first : first + step])
            flat, start = part.ravel(), np.arange(len(part)) * x.shape[1]
            for root in roots:
                at = np.full(len(part), root)
                while True:
                    below = np.where(flat.take(start + self.feature.take(at)) <= self.threshold.take(at), self.low.take(at), self.high.take(at))
                    if (below == at).all():
                        break
                    at = below
                out[first : first + step] += self.value.take(at)
        return out


class Scorer:
    """An ensemble made ready for many rows.

    A row is coded by the thresholds it is above; rows of equal codes have equal scores, so a worker remembers some.  A small
    tree keeps for each feature and code the leaves that are still open as bits; the lowest bit common to all is the row's leaf.
    """

    def __init__(self, model: Ensemble):
        self.model = model
        inner = model.low != np.arange(len(model.low))
        self.features = [int(f) for f in np.unique(model.feature[inner])]
        self.thresholds = {f: np.unique(model.threshold[inner & (model.feature == f)]) for f in self.features}
        self.masked, walked = [], []
        ends = np.append(model.roots[1:], len(model.low))
        for root, end in zip(model.roots.tolist(), ends.tolist()):
            if (~inner[root:end]).sum() <= MASK_LEAVES:
                self.masked.append(self._masks(root))
            else:
                walked.append(root)
        self.walked = np.array(walked, np.int64)
        self.known = None

    def _masks(self, root: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        m, leaves, tables = self.model, [], {}

        def visit(node: int) -> tuple[int, int]:
            """First and last leaf below a node, from left to right."""
            if m.low[node] == node:
                leaves.append(m.value[node])
                return len(leaves) - 1, len(leaves) - 1
            first, middle = visit(int(m.low[node]))
            f = int(m.feature[node])
            table = tables.setdefault(f, np.full(len(self.thresholds[f]) + 1, np.uint64(2**64 - 1)))
            closed = ((1 << (middle + 1)) - 1) ^ ((1 << first) - 1)
            table[np.searchsorted(self.thresholds[f], m.threshold[node]) + 1 :] &= np.uint64(2**64 - 1 - closed)
            return first, visit(int(m.high[node]))[1]

        visit(root)
        return sorted(tables.items()), np.array(leaves)

    def codes(self, x: np.ndarray) -> dict[int, np.ndarray]:
        return {f: np.searchsorted(t, x[:, f], side="left") for f, t in self.thresholds.items()}

    def total(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        sizes = [len(self.thresholds[f]) + 1 for f in self.features]
        if not len(self.walked) or np.prod(sizes, dtype=float) > 2.0**62:
            return self._summed(x, codes)
        # Walks are long: they are spared where a row of the same codes has been scored before.
        key = np.zeros(len(x), np.int64)
        for f, size in zip(self.features, sizes):
            key = key * size + codes[f]
        cells, first, back = np.unique(key, return_index=True, return_inverse=True)
        known, scores = self.known or (np.zeros(0, np.int64), np.zeros(0))
        place = np.searchsorted(known, cells)
        seen = np.zeros(len(cells), bool)
        seen[place < len(known)] = known[place[place < len(known)]] == cells[place < len(known)]
        out = np.zeros(len(cells))
        out[seen] = scores[place[seen]]
        new = first[~seen]
        if not len(new):
            return out[back]
        out[~seen] = self._summed(x[new], {f: c[new] for f, c in codes.items()})
        if len(known) + len(new) <= KNOWN_ROWS:
            order = np.argsort(np.concatenate([known, cells[~seen]]))
            self.known = tuple(np.concatenate(both)[order] for both in ((known, cells[~seen]), (scores, out[~seen])))
        return out[back]

    def _summed(self, x: np.ndarray, codes: Mapping[int, np.ndarray]) -> np.ndarray:
        out = self.model.walked(x, self.walked) if len(self.walked) else np.zeros(len(x))
        step = 1 << 13
        for first in range(0, len(x), step):
            rows = slice(first, first + step)
            here = {f: c[rows] for f, c in codes.items()}
            for tables, values in self.masked:
                if not tables:
                    out[rows] += values[0]
                    continue
                still = tables[0][1].take(here[tables[0][0]])
                for f, table in tables[1:]:
                    still &= table.take(here[f])
                lowest = still & (~still + np.uint64(1))
                # The exponent of a power of two is the number of its bit.
                out[rows] += values.take((lowest.astype(float).view(np.int64) >> 52) - 1023)
        return out


class Stored(NamedTuple):
    """A forest too large for the driver: its nodes as a written table."""

    nodes: DataFrame
    edges: list[np.ndarray]
    trees: int


class Splits(NamedTuple):
    """The best split of each node: ``feature`` is -1 where there is none."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray


class Rules(NamedTuple):
    """What a split must satisfy."""

    l2: float
    least_weight: float
    least_rows: float
    least_split: float


# Bins


def fit_bins(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper edges of each feature's bins, from one pass of mergeable sketches; few distinct values are bins of their own."""
    shares = [k / (BINS - 1) for k in range(BINS)]
    value = lambda f: F.when(~F.isnan(quoted(f)), quoted(f).cast("double"))
    sketches = [F.percentile_approx(value(f), shares, 20_000).alias(f"e{i}") for i, f in enumerate(features)]
    row = df.agg(*sketches, *[F.count_if(value(f).isNull()).alias(f"m{i}") for i, f in enumerate(features)]).first()
    found = []
    for i in range(len(features)):
        edges = np.unique(np.array(row[f"e{i}"] or [], float))
        # Missing values lie beyond the last edge: the largest value is one only where it tells them apart.
        found.append(edges[-(BINS - 1) :] if row[f"m{i}"] else edges[:-1])
    return found


def bin_codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Code k: above k edges.  Missing values are above all."""
    return np.searchsorted(edges, x, side="left").astype(np.uint8)


def _words(features: int) -> list[str]:
    """Names of the numbers that hold a row's codes, eight each."""
    return [f"k{i}" for i in range(-(-features // 8))]


def _keyed(edges: list[np.ndarray]):
    words = _words(len(edges))

    def keyed(batches):
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
            codes = np.zeros((b.num_rows, 8 * len(words)), np.uint8)
            for f, e in enumerate(edges):
                codes[:, f] = bin_codes(columns[f], e)
            parts = [*codes.view("<i8").T, *(c.astype(np.int32) for c in columns[-2:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in parts], [*words, "label", "fold"])

    return keyed


def _pack(features: int):
    words = len(_words(features))

    def pack(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block(parts):
            x = pa.Table.from_batches(parts)
            columns = [x.column(k).to_numpy() for k in range(x.num_columns)]
            codes = np.stack(columns[:words], axis=1).view(np.uint8)[:, :features].T if words else np.zeros((0, x.num_rows), np.uint8)
            small = [np.ascontiguousarray(codes), *(c.astype(np.uint8) for c in columns[words : words + 2]), columns[-1].astype(np.uint32)]
            data = [[number], [x.num_rows], *([c.tobytes()] for c in small)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK_ROWS - rows))
                rows += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if rows == BLOCK_ROWS:
                    yield block(held)
                    number, held, rows = number + 1, [], 0
        if held:
            yield block(held)

    return pack


def _packed(cells: DataFrame, features: int) -> DataFrame:
    """Distinct rows (words, label, fold, count) as written blocks, spread over all tasks."""
    key = [*_words(features), "label", "fold"]
    spread = cells.repartition(2 * cells.sparkSession.sparkContext.defaultParallelism, *key).sortWithinPartitions(*key)
    return materialize(spread.mapInArrow(_pack(features), BLOCKS), "binned")


def binned(df: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray], fold: Column | None = None) -> DataFrame:
    """The distinct coded rows with their numbers as written blocks; ``fold`` (0 to 255) lets fits leave rows out."""
    ship_package(df.sparkSession)
    columns = [quoted(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.select(*columns, quoted(label).cast("int").alias("label"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    words = _words(len(edges))
    coded = rows.mapInArrow(_keyed(edges), ", ".join([*(f"{w} long" for w in words), "label int", "fold int"]))
    return _packed(coded.groupBy(*words, "label", "fold").agg(F.count("*").alias("count")), len(edges))


class Block(NamedTuple):
    codes: np.ndarray  # [feature, row]
    label: np.ndarray
    fold: np.ndarray
    count: np.ndarray  # rows that are alike

    def without(self, fold: int) -> "Block":
        keep = self.fold != fold if fold else slice(None)
        return Block(self.codes[:, keep], self.label[keep], self.fold[keep], self.count[keep])


def _block(n: int, codes: bytes, label: bytes, fold: bytes, count: bytes) -> Block:
    small = (np.frombuffer(x, np.uint8) for x in (codes, label, fold))
    codes, label, fold = small
    return Block(codes.reshape(-1, n), label, fold, np.frombuffer(count, np.uint32))


# Splits


def _cells(key: np.ndarray, sums: Sequence[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys that occur, sorted, with their sums: counted where keys are dense, sorted where they are not."""
    if size <= 4 * len(key):
        once = {id(s): np.bincount(key, s, size) for s in sums}
        dense = [once[id(s)] for s in sums]
        at = np.flatnonzero(dense[1] > 0)
        return at, [d[at] for d in dense]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[start], [np.add.reduceat(s[order], start) if len(start) else s[:0] for s in sums]


def better_splits(best: Splits, feature: int, bins: int, at: np.ndarray, sums: list[np.ndarray], totals: list[np.ndarray], rules: Rules) -> None:
    """Put the splits by a feature where they beat what is known.  ``at``: node * bins + code of the cells that are not empty."""
    if not len(at):
        return
    node = at // bins
    head = np.append(True, node[1:] != node[:-1])
    start = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    low = [np.cumsum(s) for s in sums]
    low = [c - (c[start] - s[start])[which] for c, s in zip(low, sums)]
    g, h, c = ([t[node], s] for t, s in zip(totals, low))
    high = [t - s for t, s in (g, h, c)]
    g, h, c = g[1], h[1], c[1]
    last = np.append(head[1:], True)
    fits = ~last & (h >= rules.least_weight) & (high[1] >= rules.least_weight) & (c >= rules.least_rows) & (high[2] >= rules.least_rows)
    fits &= (h + rules.l2 > 0) & (high[1] + rules.l2 > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + rules.l2) + high[0] ** 2 / (high[1] + rules.l2) - totals[0][node] ** 2 / (totals[1][node] + rules.l2)
    gain = np.where(fits, gain, -np.inf)
    most = np.maximum.reduceat(gain, start)
    first = np.full(len(start), len(at))
    hit = np.flatnonzero(gain == most[which])
    np.minimum.at(first, which[hit], hit)
    own = node[start]
    wins = most > np.maximum(best.gain[own], LEAST_GAIN)
    best.feature[own[wins]], best.gain[own[wins]], best.cut[own[wins]] = feature, most[wins], (at % bins)[first[wins]]


def _nothing(nodes: int) -> Splits:
    return Splits(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes))


class Tree:
    """Nodes as they grow."""

    def __init__(self):
        self.feature, self.cut, self.low, self.high = ([] for _ in range(4))
        self.value, self.gain, self.weight = [], [], []

    def add(self, value: float, weight: float) -> int:
        node = len(self.feature)
        for column, entry in zip((self.feature, self.cut, self.low, self.high, self.value, self.gain, self.weight), (0, BINS, node, node, value, 0.0, weight)):
            column.append(entry)
        return node

    def add_all(self, values: list[float], weights: list[float]) -> int:
        """Number of the first of several new nodes."""
        first, n = len(self.feature), len(values)
        own = range(first, first + n)
        for column, entries in zip((self.feature, self.cut, self.low, self.high, self.value, self.gain, self.weight), ([0] * n, [BINS] * n, own, own, values, [0.0] * n, weights)):
            column.extend(entries)
        return first

    def split(self, node: int, feature: int, cut: int, gain: float, low: int, high: int) -> None:
        self.feature[node], self.cut[node], self.gain[node], self.low[node], self.high[node] = feature, cut, gain, low, high


def grow(codes: np.ndarray, bins: Sequence[int], g: np.ndarray, h: np.ndarray, count: np.ndarray | None, depth: int, rules: Rules,
         leaf, draw=None) -> tuple[Tree, np.ndarray]:
    """A tree from all rows given, level by level, and each row's leaf.

    ``leaf`` turns sums (g, h) into a value; ``draw`` gives, for so many nodes, which features each may use.  A node whose
    features give no split may use the others.
    """
    tree, rows = Tree(), len(g)
    sums = [g, h, count if count is not None else h]
    totals = [np.array([s.sum()]) for s in sums]
    tree.add(leaf(totals[0][0], totals[1][0]), totals[1][0])
    at = np.zeros(rows, np.int64)
    open_, inside, slot = np.zeros(1, np.int64), np.arange(rows), np.zeros(rows, np.int64)
    for _ in range(depth):
        allowed = np.ones((len(open_), len(codes)), bool) if draw is None else draw(len(open_))
        best = _nothing(len(open_))
        here = sums if len(inside) == rows else [s[inside] for s in sums[:2]]
        here = [*here[:2], here[1] if count is None else count if len(inside) == rows else count[inside]]
        for again in (False, True):
            for f in range(len(codes)):
                usable = allowed[:, f] & (totals[2] >= rules.least_split)
                if not usable.any():
                    continue
                if usable.all():
                    key, mine = slot * bins[f] + (codes[f] if len(inside) == rows else codes[f][inside]), here
                else:
                    own = np.flatnonzero(usable[slot])
                    key, mine = slot[own] * bins[f] + codes[f][inside[own]], [s[own] for s in here[:2]]
                    mine.append(mine[1] if count is None else here[2][own])
                cells, parts = _cells(key, mine, len(open_) * bins[f])
                better_splits(best, f, bins[f], cells, parts, totals, rules)
            if draw is None or not (rest := best.feature < 0).any():
                break
            allowed = ~allowed & rest[:, None]
        found = np.flatnonzero(best.feature >= 0)
        if not len(found):
            break
        child = np.full(len(open_), -1)
        child[found] = 2 * np.arange(len(found))
        kept = np.flatnonzero(child[slot] >= 0)
        inside, slot = inside[kept], slot[kept]
        right = codes[best.feature[slot], inside] > best.cut[slot]
        slot = child[slot] + right
        totals = [np.bincount(slot, s[inside], 2 * len(found)) for s in sums]
        first = tree.add_all(list(map(leaf, totals[0].tolist(), totals[1].tolist())), totals[1].tolist())
        for k, node in enumerate(open_[found].tolist()):
            tree.split(node, int(best.feature[found[k]]), int(best.cut[found[k]]), float(best.gain[found[k]]), first + 2 * k, first + 2 * k + 1)
        open_ = first + np.arange(2 * len(found))
        at[inside] = open_[slot]
    return tree, at


def _node_rows(fit: int, tree: int, nodes: Sequence[int], grown: Tree) -> pa.RecordBatch:
    """A tree's nodes as rows, under the numbers given."""
    name = np.array(nodes, np.int64)
    kinds = {"int": np.int32, "long": np.int64, "double": np.float64}
    data = dict(fit=np.full(len(name), fit), tree=np.full(len(name), tree), node=name, feature=grown.feature, cut=grown.cut, low=name[grown.low],
                high=name[grown.high], value=grown.value, gain=grown.gain, weight=grown.weight)
    columns = [(c, kinds[k]) for c, k in (x.split() for x in NODES.split(","))]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(data[c]).astype(k)) for c, k in columns], [c for c, _ in columns])


# Boosting


def _gradients(margin: np.ndarray, label: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    w = np.where(label == 1, positive, 1.0)
    return w * (p - label), w * p * (1 - p)


def _boost_rules(p: Mapping) -> Rules:
    return Rules(p["reg_lambda"], p["min_child_weight"], 0.0, 0.0)


def _start(zeros: float, ones: float) -> float:
    """Log-odds of the weighted labels."""
    return float(np.log(max(ones, 1e-6) / max(zeros, 1e-6)))


def _columns(p: Mapping, features: int, tree: int) -> np.ndarray:
    """Features that a tree may use."""
    count = max(1, int(features * p["colsample_bytree"]))
    return np.sort(np.random.default_rng([p["random_state"], tree]).permutation(features)[:count])


def _sampled(p: Mapping, tree: int, block: int, count: np.ndarray) -> np.ndarray:
    """How many of the rows that are alike a tree sees."""
    if p["subsample"] >= 1:
        return count.astype(float)
    rng = np.random.default_rng([p["random_state"], tree, block])
    seen = (rng.random(len(count)) < p["subsample"]).astype(float)
    many = np.flatnonzero(count > 1)
    seen[many] = rng.binomial(count[many], p["subsample"])
    return seen


def _leaf(p: Mapping):
    return lambda g, h: -p["learning_rate"] * g / (h + p["reg_lambda"]) if h + p["reg_lambda"] > 0 else 0.0


def boost(blocks: Sequence[tuple[int, Block]], bins: Sequence[int], p: Mapping, base: float) -> list[Tree]:
    """All trees of a fit whose rows are at hand."""
    codes, label = (np.concatenate([getattr(b, c) for _, b in blocks], axis=-1) for c in ("codes", "label"))
    margin, trees = np.full(len(label), base), []
    for t in range(p["n_estimators"]):
        g, h = _gradients(margin, label, p["scale_pos_weight"])
        keep = np.concatenate([_sampled(p, t, k, b.count) for k, b in blocks])
        g, h = g * keep, h * keep
        own = _columns(p, len(codes), t)
        mine = [bins[f] for f in own]
        if sum(mine) << p["max_depth"] <= MOST_SUMS:
            tree, at = _grow_boosted(codes[own], mine, g, h, p["max_depth"], _boost_rules(p), _leaf(p))
        else:
            tree, at = grow(codes[own], mine, g, h, None, p["max_depth"], _boost_rules(p), _leaf(p))
        tree.feature = [int(own[f]) for f in tree.feature]
        margin += np.array(tree.value)[at]
        trees.append(tree)
    return trees


def _grow_boosted(codes: np.ndarray, bins: Sequence[int], g: np.ndarray, h: np.ndarray, depth: int, rules: Rules, leaf) -> tuple[Tree, np.ndarray]:
    """As ``grow`` where every node may use every feature: only the smaller child of a split is summed, its sibling is the rest."""
    tree, n, live, flat = Tree(), len(g), h > 0, np.ascontiguousarray(codes).ravel()
    totals = [np.array([g.sum()]), np.array([h.sum()])]
    tree.add(leaf(totals[0][0], totals[1][0]), totals[1][0])
    at, open_ = np.zeros(n, np.int64), np.zeros(1, np.int64)

    def summed(slots: np.ndarray, count: int, split: bool) -> list[np.ndarray]:
        """Sums (g, h, rows) of the nodes that ``slots`` numbers, feature by feature, after the last splits have been followed."""
        out = [np.zeros((3, count * b)) for b in bins]
        feature, cut, low, high = (np.array(c) for c in (tree.feature, tree.cut, tree.low, tree.high))
        feature *= n
        step = max(1 << 15, 4 * count * max(bins))
        for first in range(0, n, step):
            rows = slice(first, min(first + step, n))
            here = at[rows]
            if split:
                right = flat.take(feature.take(here) + np.arange(rows.start, rows.stop)) > cut.take(here)
                here = np.where(right, high.take(here), low.take(here))
                at[rows] = here
            if not count:
                continue
            slot = slots.take(here)
            inside = np.flatnonzero((slot >= 0) & live[rows])
            slot, gs, hs = slot[inside], g[rows][inside], h[rows][inside]
            for f, b in enumerate(bins):
                key = slot * b + codes[f][rows][inside]
                for i, w in enumerate((gs, hs, None)):
                    out[f][i] += np.bincount(key, w, count * b)
        return [o.reshape(3, count, b) for o, b in zip(out, bins)]

    hist = summed(np.zeros(1, np.int64), 1, False) if depth else []
    for level in range(depth):
        best = _nothing(len(open_))
        for f, b in enumerate(bins):
            parts = hist[f].reshape(3, -1)
            cells = np.flatnonzero(parts[2] > 0)
            better_splits(best, f, b, cells, [parts[0][cells], parts[1][cells], parts[1][cells]], [*totals, totals[1]], rules)
        found = np.flatnonzero(best.feature >= 0)
        if not len(found):
            break
        low = np.array([hist[best.feature[s]][:, s, : best.cut[s] + 1].sum(axis=1) for s in found]).T
        every = np.array([hist[0][2, s].sum() for s in found])
        totals = [np.stack([part, t[found] - part], axis=1).ravel() for part, t in zip(low, totals)]
        first = tree.add_all(list(map(leaf, totals[0].tolist(), totals[1].tolist())), totals[1].tolist())
        for k, s in enumerate(found.tolist()):
            tree.split(int(open_[s]), int(best.feature[s]), int(best.cut[s]), float(best.gain[s]), first + 2 * k, first + 2 * k + 1)
        # Rows only move below the nodes that were split last: others are their own children.
        pairs, more = np.arange(len(found)), level + 1 < depth
        smaller = (low[2] > every - low[2]).astype(np.int64)
        slots = np.full(len(tree.feature), -1)
        slots[first + 2 * pairs + smaller] = pairs
        part = summed(slots, len(found) if more else 0, True)
        if not more:
            break
        below = []
        for own, whole, b in zip(part, hist, bins):
            rest = whole[:, found] - own
            rest[:, rest[2] == 0] = 0
            both = np.zeros((3, 2 * len(found), b))
            both[:, 2 * pairs + smaller], both[:, 2 * pairs + 1 - smaller] = own, rest
            below.append(both)
        hist, open_ = below, first + np.arange(2 * len(found))
    return tree, at


def _walk(codes: np.ndarray, tree: Tree) -> np.ndarray:
    return _reached(codes, *(np.array(c) for c in (tree.feature, tree.cut, tree.low, tree.high)))


def _reached(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The leaf of each column of codes."""
    total = codes.shape[1]
    at, flat, step = np.zeros(total, np.int64), np.ascontiguousarray(codes).ravel(), 1 << 13
    start = np.asarray(feature, np.int64) * total
    for first in range(0, total, step):
        rows = np.arange(first, min(first + step, total))
        here = at[first : first + step]
        while True:
            below = np.where(flat.take(start.take(here) + rows) <= cut.take(here), low.take(here), high.take(here))
            if (below == here).all():
                break
            here = below
        at[first : first + step] = here
    return at


def boost_by_levels(blocks: DataFrame, bins: Sequence[int], p: Mapping, fold: int, base: float) -> list[Tree]:
    """Trees of a fit of any size: each level is one job that sums histograms over all blocks.

    Margins travel with the blocks.  They are added to after each tree and now and then computed anew from the
    written blocks, so that lost executors cost at most ``REBUILT`` steps.
    """
    context, trees = blocks.sparkSession.sparkContext, []
    rules, leaf, starts = _boost_rules(p), _leaf(p), np.concatenate([[0], np.cumsum(bins)])

    def read(row):
        return row.block, _block(row.n, row.codes, row.label, row.fold, row.count_).without(fold)

    def stepped(fresh, t):
        """Margins after some trees, and what the rows weigh in the next one."""

        def step(item):
            k, b, margin = item[:3]
            for tree in fresh:
                margin = margin + np.array(tree.value)[_walk(b.codes, tree)]
            g, h = _gradients(margin, b.label, p["scale_pos_weight"])
            keep = _sampled(p, t, k, b.count)
            return k, b, margin, g * keep, h * keep

        return step

    written = blocks.withColumnRenamed("count", "count_").rdd.map(read).map(lambda x: (*x, np.full(len(x[1].label), base)))
    state, before = written.map(stepped((), 0)).persist(StorageLevel.MEMORY_AND_DISK), None
    for t in range(p["n_estimators"]):
        own = _columns(p, len(bins), t)
        tree, open_ = Tree(), [0]
        for _ in range(p["max_depth"]):
            slots = {node: k for k, node in enumerate(open_)}

            def histograms(item, tree=tree, slots=slots, own=own):
                _, b, _, g, h = item
                at = _walk(b.codes, tree) if tree.feature else np.zeros(len(g), np.int64)
                names = np.full(max(len(tree.feature), 1), -1)
                names[list(slots)] = list(slots.values())
                inside = np.flatnonzero((h > 0) & (names[at] >= 0))
                slot, total = names[at[inside]], starts[-1]
                out = np.zeros((2, len(slots), total))
                for f in own:
                    key = slot * total + starts[f] + b.codes[f][inside]
                    for i, s in enumerate((g, h)):
                        out[i] += np.bincount(key, s[inside], len(slots) * total).reshape(len(slots), total)
                return [(s, out[:, s]) for s in np.unique(slot).tolist()]

            def chosen(item, own=own):
                slot, sums = item
                f0 = own[0]
                totals = [s[starts[f0] : starts[f0 + 1]].sum(keepdims=True) for s in (sums[0], sums[1], sums[1])]
                best = _nothing(1)
                for f in own:
                    parts = [sums[i, starts[f] : starts[f + 1]] for i in (0, 1, 1)]
                    at = np.flatnonzero(parts[1] > 0)
                    better_splits(best, int(f), bins[f], at, [s[at] for s in parts], totals, rules)
                f, cut = int(best.feature[0]), int(best.cut[0])
                low = sums[:, starts[f] : starts[f] + cut + 1].sum(axis=1) if f >= 0 else np.zeros(2)
                return slot, float(totals[0][0]), float(totals[1][0]), f, cut, float(best.gain[0]), float(low[0]), float(low[1])

            found = sorted(state.flatMap(histograms).reduceByKey(np.add, min(len(open_), context.defaultParallelism)).map(chosen).collect())
            if before is not None:  # the first job of a tree has made its state from the last one's
                before.unpersist()
                before = None
            if not tree.feature:
                tree.add(leaf(*(found[0][1:3] if found else (0.0, 0.0))), found[0][2] if found else 0.0)
            following = []
            for slot, g, h, feature, cut, gain, g_low, h_low in found:
                if feature >= 0:
                    pair = [tree.add(leaf(g_low, h_low), h_low), tree.add(leaf(g - g_low, h - h_low), h - h_low)]
                    tree.split(open_[slot], feature, cut, gain, *pair)
                    following += pair
            open_ = following
            if not open_:
                break
        trees.append(tree)
        if t + 1 < p["n_estimators"]:
            before = state
            made = written.map(stepped(tuple(trees), t + 1)) if len(trees) % REBUILT == 0 else before.map(stepped((tree,), t + 1))
            state = made.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return trees


def fit_boosted(blocks: DataFrame, edges: list[np.ndarray], fits: Mapping[int, tuple[Mapping, int]]) -> dict[int, Ensemble]:
    """Boosted trees of several fits at once: number -> (parameters, fold left out, 0 for none)."""
    bins = [len(e) + 1 for e in edges]
    classes, rows = _class_counts(blocks)
    start = {}
    for k, (p, fold) in fits.items():
        ones, zeros = (sum(n for (f, y), n in classes.items() if y == label and (f != fold or not fold)) for label in (1, 0))
        start[k] = _start(zeros, ones * p["scale_pos_weight"])
    if rows > LOCAL_ROWS:
        grown = {k: boost_by_levels(blocks, bins, p, fold, start[k]) for k, (p, fold) in fits.items()}
        return {k: _ensemble([_node_rows(k, t, range(len(x.feature)), x) for t, x in enumerate(trees)], edges, start[k])[k] for k, trees in grown.items()}

    # The longest fits start first.
    turns = sorted(fits, key=lambda k: -fits[k][0]["n_estimators"] * fits[k][0]["max_depth"])

    def run(table: pa.Table) -> pa.Table:
        k = turns[table.column("turn")[0].as_py()]
        p, fold = fits[k]
        own = []
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            own.append((r["block"], _block(r["n"], r["codes"], r["label"], r["fold"], r["count"]).without(fold)))
        trees = boost(own, bins, p, start[k])
        return pa.Table.from_batches([_node_rows(k, t, range(len(x.feature)), x) for t, x in enumerate(trees)])

    each = blocks.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in range(len(turns))])))
    # A range for each fit, where hashing would deal several to one task.
    nodes = each.repartitionByRange(len(fits), "turn").groupBy("turn").applyInArrow(run, NODES).toArrow()
    return {k: m for n in fits for k, m in _ensemble(nodes.filter(pc.equal(nodes.column("fit"), n)).to_batches(), edges, start[n]).items()}


def left_out_scores(blocks: DataFrame, edges: list[np.ndarray], models: Mapping[int, Ensemble], folds: int, boosted: bool) -> DataFrame:
    """Every distinct row scored by the models that left its fold out: fit ``c * folds + f`` left out fold f + 1."""
    shared = blocks.sparkSession.sparkContext.broadcast({k: Scorer(m) for k, m in models.items()})
    candidates, names = len(models) // folds, ("candidate", "fold", "label", "score", "count")

    def scored(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = _block(r["n"], r["codes"], r["label"], r["fold"], r["count"])
                # A bin's upper edge stands for its values.
                x = np.stack([np.append(e, np.inf)[c] for e, c in zip(edges, b.codes)], axis=1)
                for f in range(folds):
                    held = np.flatnonzero(b.fold == f + 1)
                    for c in range(candidates):
                        scorer = shared.value[c * folds + f]
                        model, total = scorer.model, scorer.total(x[held])
                        score = 1 / (1 + np.exp(-model.base - total)) if boosted else total / len(model.roots)
                        data = (np.full(len(held), c + 1, np.int32), np.full(len(held), f + 1, np.int32), b.label[held].astype(np.int32), score, b.count[held].astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in data], list(names))

    spread = blocks.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, "block")
    found = materialize(spread.mapInArrow(scored, "candidate int, fold int, label int, score double, count long"), "search-scores")
    shared.destroy()
    return found


def _class_counts(blocks: DataFrame) -> tuple[dict[tuple[int, int], int], int]:
    """Rows by fold and label, and the number of distinct ones."""

    def counts(batches):
        for b in batches:
            for label, fold, count in zip(*(b.column(k).to_pylist() for k in range(3))):
                key = np.frombuffer(fold, np.uint8).astype(np.int64) * 256 + np.frombuffer(label, np.uint8)
                rows, alike = np.bincount(key, np.frombuffer(count, np.uint32)), np.bincount(key)
                at = np.flatnonzero(alike)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at].astype(np.int64)), pa.array(alike[at])], ["key", "n", "d"])

    found = blocks.select("label", "fold", "count").mapInArrow(counts, "key long, n long, d long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()
    return {(r.key // 256, r.key % 256): r.n for r in found}, sum(r.d for r in found)


# Forests


def _forest_rules(p: Mapping) -> Rules:
    return Rules(0.0, 0.0, p["min_samples_leaf"], p["min_samples_split"])


def _per_node(p: Mapping, features: int) -> int:
    wanted = p["max_features"]
    if wanted in ("sqrt", "log2"):
        return max(1, int(np.sqrt(features) if wanted == "sqrt" else np.log2(features)))
    return features if wanted in (None, "all") else max(1, int(wanted * features) if isinstance(wanted, float) else int(wanted))


def _drawer(p: Mapping, features: int, key: Sequence[int]):
    rng, count = np.random.default_rng([p["random_state"], *key]), _per_node(p, features)

    def draw(nodes: int) -> np.ndarray:
        allowed = np.zeros((nodes, features), bool)
        np.put_along_axis(allowed, rng.random((nodes, features)).argsort(axis=1)[:, :count], True, axis=1)
        return allowed

    return draw


def _times(p: Mapping, tree: int, block: int, count: np.ndarray) -> np.ndarray:
    """How often a tree draws the rows of a block: a Poisson number of each, added up for rows that are alike."""
    return np.random.default_rng([p["random_state"], tree, block]).poisson(count).astype(np.uint32)


def _share(g: float, h: float) -> float:
    return g / h if h > 0 else 0.0


def fit_forest(blocks: DataFrame, edges: list[np.ndarray], fits: Mapping[int, tuple[Mapping, int]]) -> dict[int, Ensemble | Stored]:
    """Random forests of several fits at once: number -> (parameters, fold left out, 0 for none).

    Every tree draws rows with replacement (Poisson counts by tree and block).  The top of a tree, down to nodes of
    ``LOCAL_ROWS`` distinct rows, is split by summed histograms of the features drawn; then each node's rows go to one task,
    which grows the rest.  Nodes of the top that cannot be split any more are done there.
    """
    bins, starts = [len(e) + 1 for e in edges], np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    classes, rows = _class_counts(blocks)
    weights: dict[int, tuple[float, float]] = {}
    for k, (p, fold) in fits.items():
        zeros, ones = (sum(n for (f, y), n in classes.items() if y == label and (f != fold or not fold)) for label in (0, 1))
        weights[k] = (1.0, 1.0) if p["class_weight"] is None else ((zeros + ones) / (2 * max(zeros, 1)), (zeros + ones) / (2 * max(ones, 1)))
    trees = [(k, t) for k, (p, _) in fits.items() for t in range(p["n_estimators"])]
    tops = {x: Tree() for x in trees}
    for x in trees:
        tops[x].add(0.0, 0.0)
    large = {x: [0] for x in trees} if rows > LOCAL_ROWS else {}
    depths = {x: {0: 0} for x in trees}

    def placed(b: Block, block: int, x: tuple[int, int], top: Tree):
        """Rows of a block that a tree has drawn: places, nodes and counts."""
        p, fold = fits[x[0]]
        count = _times(p, x[1], block, b.count)
        if fold:
            count = count * (b.fold != fold)
        own = np.flatnonzero(count)
        return own, _walk(b.codes[:, own], top), count[own]

    settled: dict[tuple[int, int], set[int]] = {x: set() for x in trees}  # leaves of the tops: their rows go nowhere
    others: set[tuple[tuple[int, int], int]] = set()  # nodes that the features drawn for them did not split

    def tried(x: tuple[int, int], node: int, others=others) -> np.ndarray:
        allowed = _drawer(fits[x[0]][0], len(bins), (x[1], node))(1)[0]
        return np.flatnonzero(~allowed if (x, node) in others else allowed)

    while large:
        asked = {x: {node: i for i, node in enumerate(nodes)} for x, nodes in large.items()}
        now = {x: tops[x] for x in asked}
        use = {(x, i): tried(x, node) for x, nodes in large.items() for i, node in enumerate(nodes)}

        def histograms(row, asked=asked, now=now, use=use):
            """For every node asked for and each bin: rows of class 0, of class 1, and distinct ones."""
            b, out = _block(row.n, row.codes, row.label, row.fold, row.count_), []
            for x, slots in asked.items():
                own, at, count = placed(b, row.block, x, now[x])
                names = np.full(len(now[x].feature), -1)
                names[list(slots)] = list(slots.values())
                slot = names[at]
                for s in np.unique(slot[slot >= 0]).tolist():
                    mine = slice(None) if len(names) == 1 else slot == s
                    rows, n = own[mine], count[mine].astype(float)
                    label = b.label[rows].astype(np.int64)
                    sums = np.zeros((3, starts[-1]))
                    for f in use[x, s]:
                        key, place = 2 * b.codes[f][rows].astype(np.int64) + label, slice(starts[f], starts[f + 1])
                        sums[:2, place] = np.bincount(key, n, 2 * bins[f]).reshape(-1, 2).T
                        sums[2, place] = np.bincount(key, None, 2 * bins[f]).reshape(-1, 2).sum(axis=1)
                    out.append(((x, s), sums))
            return out

        def chosen(item, asked=asked, use=use):
            (x, s), sums = item
            (zero, one), node, best = weights[x[0]], list(asked[x])[s], _nothing(1)
            whole = sums[:, starts[use[x, s][0]] : starts[use[x, s][0] + 1]].sum(axis=1)
            weighed = lambda c: [one * c[1], zero * c[0] + one * c[1], c[0] + c[1]]
            for f in use[x, s]:
                parts = sums[:, starts[f] : starts[f + 1]]
                at = np.flatnonzero(parts[2] > 0)
                better_splits(best, int(f), bins[f], at, weighed(parts[:, at]), weighed(whole[:, None]), _forest_rules(fits[x[0]][0]))
            f, cut = int(best.feature[0]), int(best.cut[0])
            low = sums[:, starts[f] : starts[f] + cut + 1].sum(axis=1) if f >= 0 else np.zeros(3)
            return x, node, whole.tolist(), f, cut, float(best.gain[0]), low.tolist()

        found, large = blocks.withColumnRenamed("count", "count_").rdd.flatMap(histograms).reduceByKey(np.add).map(chosen).collect(), {}
        for x, node, whole, feature, cut, gain, low in sorted(found, key=lambda r: (r[0], r[1])):
            top, p, (zero, one) = tops[x], fits[x[0]][0], weights[x[0]]
            top.weight[node] = zero * whole[0] + one * whole[1]
            top.value[node] = _share(one * whole[1], top.weight[node])
            depth = depths[x][node]
            if feature < 0 and (x, node) not in others and depth < p["max_depth"] and whole[0] and whole[1] and _per_node(p, len(bins)) < len(bins):
                others.add((x, node))
                large.setdefault(x, []).append(node)
                continue
            if feature < 0 or depth >= p["max_depth"]:
                settled[x].add(node)
                continue
            pair = [top.add(0.0, 0.0), top.add(0.0, 0.0)]
            top.split(node, feature, cut, gain, *pair)
            for child, (n0, n1, distinct) in zip(pair, (low, [w - n for w, n in zip(whole, low)])):
                depths[x][child] = depth + 1
                if not n0 or not n1 or depth + 1 >= p["max_depth"] or n0 + n1 < p["min_samples_split"]:
                    top.weight[child] = zero * n0 + one * n1
                    top.value[child] = _share(one * n1, top.weight[child])
                    settled[x].add(child)
                elif distinct > LOCAL_ROWS:
                    large.setdefault(x, []).append(child)

    def pieces(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = _block(r["n"], r["codes"], r["label"], r["fold"], r["count"])
                out = []
                for x in trees:
                    if 0 in settled[x]:
                        continue
                    own, at, count = placed(b, r["block"], x, tops[x])
                    for node in sorted(set(np.unique(at).tolist()) - settled[x]):
                        mine = own[at == node]
                        out.append((x[0], x[1], node, r["block"], len(mine), b.codes[:, mine].tobytes(), b.label[mine].tobytes(), count[at == node].tobytes()))
                    if len(out) >= 16:
                        yield _pieces(out)
                        out = []
                if out:
                    yield _pieces(out)

    def below(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["block"])
        k, t, node = parts[0]["fit"], parts[0]["tree"], parts[0]["node"]
        p = fits[k][0]
        codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(-1, r["n"]) for r in parts], axis=1)
        label, count = (np.concatenate([np.frombuffer(r[c], kind) for r in parts]) for c, kind in (("label", np.uint8), ("count", np.uint32)))
        count = count.astype(float)
        by_class = np.array(weights[k])
        if p["class_weight"] == "balanced_subsample" and node == 0:
            each = np.bincount(label, count, 2)
            by_class = each.sum() / (2 * np.maximum(each, 1))
        w = count * by_class[label]
        grown, _ = grow(codes, bins, w * label, w, count, p["max_depth"] - depths[k, t][node], _forest_rules(p), _share, _drawer(p, len(bins), (t, node, 1)))
        # Below a node of the top, numbers start beyond those of the top.
        names = [node, *(((node + 1) << 32) + i for i in range(1, len(grown.feature)))]
        return pa.Table.from_batches([_node_rows(k, t, names, grown)])

    nodes = blocks.mapInArrow(pieces, PIECES).groupBy("fit", "tree", "node").applyInArrow(below, NODES)
    upper = []
    for (k, t), top in tops.items():
        ready = [i for i in range(len(top.feature)) if top.low[i] != i or i in settled[k, t]]
        if ready:
            part = _node_rows(k, t, range(len(top.feature)), top)
            upper.append(part.take(pa.array(ready)))
    if upper:
        nodes = nodes.unionByName(blocks.sparkSession.createDataFrame(pa.Table.from_batches(upper)))
    nodes = materialize(nodes, "forest")
    if nodes.count() > HELD_NODES:
        return {k: Stored(nodes.where(F.col("fit") == k), edges, p["n_estimators"]) for k, (p, _) in fits.items()}
    every = nodes.toArrow()
    return {k: m for n in fits for k, m in _ensemble(every.filter(pc.equal(every.column("fit"), n)).to_batches(), edges, 0.0).items()}


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in PIECES.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows), columns)], [c for c, _ in columns])


# Models


def _ensemble(batches: Sequence[pa.RecordBatch], edges: list[np.ndarray], base: float) -> dict[int, Ensemble]:
    """The one fit's nodes as arrays, with thresholds in place of bins."""
    t = pa.Table.from_batches(batches)
    c = {name: t.column(name).to_numpy() for name in t.column_names}
    order = np.lexsort((c["node"], c["tree"]))
    c = {name: v[order] for name, v in c.items()}
    head = np.flatnonzero(np.append(True, c["tree"][1:] != c["tree"][:-1]))
    at = {}
    for side in ("low", "high"):
        own = np.empty(len(order), np.int64)
        for a, b in zip(head, np.append(head[1:], len(order))):
            own[a:b] = a + np.searchsorted(c["node"][a:b], c[side][a:b])
        at[side] = own
    leaf = at["low"] == np.arange(len(order))
    threshold = np.full(len(order), np.inf)
    for f, e in enumerate(edges):
        inner = ~leaf & (c["feature"] == f)
        threshold[inner] = e[c["cut"][inner]] if len(e) else np.inf
    depth, reached = 0, head[~leaf[head]]
    while len(reached):
        below = np.concatenate([at["low"][reached], at["high"][reached]])
        depth, reached = depth + 1, below[~leaf[below]]
    return {int(c["fit"][0]): Ensemble(head, np.where(leaf, 0, c["feature"]), threshold, at["low"], at["high"], c["value"], c["gain"], c["weight"], depth, base)}


def importances(model: Ensemble | Stored, features: int, boosted: bool) -> np.ndarray:
    """Shares that add up to 1: mean gain of a feature's splits (boosting), or mean over trees of its part of the decrease (forest)."""
    if isinstance(model, Stored):
        each = np.zeros((model.trees, features))
        for r in model.nodes.where("low <> node").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
            each[r.tree, r.feature] = r.gain
        return _mean_shares(each)
    inner = model.low != np.arange(len(model.low))
    if boosted:
        total, n = (np.bincount(model.feature[inner], w, features) for w in (model.gain[inner], None))
        shares = np.divide(total, n, out=np.zeros(features), where=n > 0)
    else:
        tree = np.searchsorted(model.roots, np.arange(len(model.low)), side="right") - 1
        return _mean_shares(np.bincount(tree[inner] * features + model.feature[inner], model.gain[inner], len(model.roots) * features).reshape(-1, features))
    return shares / shares.sum() if shares.sum() > 0 else shares


def _mean_shares(each: np.ndarray) -> np.ndarray:
    """Mean over trees of each feature's part of a tree's decrease."""
    total = each.sum(axis=1, keepdims=True)
    shares = np.divide(each, total, out=np.zeros_like(each), where=total > 0).mean(axis=0)
    return shares / shares.sum() if shares.sum() > 0 else shares


def stored_probability(df: DataFrame, model: Stored, columns: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the probability of class 1 by a written forest.

    Rows of equal codes are scored once.  A few trees meet a lot of distinct rows in a task; sums over all trees are added
    up block by block and joined back to the rows.
    """
    edges, trees = model.edges, model.trees
    ship_package(df.sparkSession)
    words = _words(len(edges))

    def word(first):
        own = edges[first : first + 8]

        @pandas_udf("long")
        def coded(*series):
            import pandas as pd

            codes = np.zeros((len(series[0]), 8), np.uint8)
            for f, (s, e) in enumerate(zip(series, own)):
                codes[:, f] = bin_codes(s.to_numpy(float, na_value=np.nan), e)
            return pd.Series(codes.view("<i8")[:, 0])

        return coded(*columns[first : first + 8])

    inner = [f"__{w}" for w in words]
    keyed = df.withColumns({w: word(8 * i) for i, w in enumerate(inner)})
    one = [F.lit(v).alias(n) for n, v in (("label", 0), ("fold", 0), ("count", 1))]
    blocks = _packed(keyed.select(*[F.col(i).alias(w) for i, w in zip(inner, words)]).distinct().select("*", *one), len(edges)).select("block", "n", "codes")
    lots = max(1, -(-blocks.count() * BLOCK_ROWS // LOCAL_ROWS))
    groups = -(-trees // TREES_A_TASK)
    series = lambda n, as_: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(as_)
    nodes = model.nodes.select("tree", "node", "feature", "cut", "low", "high", "value", F.pmod("tree", F.lit(groups)).alias("group"), series(lots, "lot"))
    rows = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(lots)).cast("int").alias("lot"), series(groups, "group"))

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        c = {n: left.column(n).to_numpy() for n in ("tree", "node", "feature", "cut", "low", "high", "value")}
        grown = []
        for t in np.unique(c["tree"]):
            own = np.flatnonzero(c["tree"] == t)
            own = own[np.argsort(c["node"][own])]
            names = c["node"][own]
            low, high = (np.searchsorted(names, c[side][own]) for side in ("low", "high"))
            grown.append((c["feature"][own], c["cut"][own], low, high, c["value"][own]))
        sums = []
        for n, codes in zip(right.column("n").to_pylist(), right.column("codes").to_pylist()):
            codes, total = np.frombuffer(codes, np.uint8).reshape(-1, n), np.zeros(n)
            for feature, cut, low, high, value in grown:
                total += value[_reached(codes, feature, cut, low, high)]
            sums.append(total.tobytes())
        return pa.table({"block": right.column("block"), "sums": pa.array(sums, pa.binary())})

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.column("n")[0].as_py()
        total = sum(np.frombuffer(s, float) for s in left.column("sums").to_pylist())
        codes = np.zeros((n, 8 * len(words)), np.uint8)
        codes[:, : len(edges)] = np.frombuffer(right.column("codes")[0].as_py(), np.uint8).reshape(-1, n).T
        return pa.table({**{w: np.ascontiguousarray(k) for w, k in zip(inner, codes.view("<i8").T)}, "__score": total / trees})

    parts = nodes.groupBy("group", "lot").cogroup(rows.groupBy("group", "lot")).applyInArrow(walked, "block long, sums binary")
    schema = ", ".join([*(f"{w} long" for w in inner), "__score double"])
    scores = materialize(parts.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(scored, schema), "cell-scores")
    kept = [quoted(c) for c in df.columns if c != name]
    return keyed.join(scores, inner).select(*kept, F.col("__score").alias(name))


def probability(spark: SparkSession, model: Ensemble, boosted: bool, columns: Sequence[Column]) -> Column:
    """Probability of class 1 as a column over double columns."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Scorer(model))

    @pandas_udf("double")
    def score(*series):
        import pandas as pd

        own = shared.value.model
        x = np.stack([s.to_numpy(float, na_value=np.nan) for s in series], axis=1)
        total = shared.value.total(x)
        return pd.Series(1 / (1 + np.exp(-own.base - total)) if boosted else total / len(own.roots))

    return score(*columns)
