"""Near-duplicate documents by SimHash: binary tries of the fingerprints are joined with themselves.

A fingerprint has 64 bits, and two documents are linked where at most two differ.  Three tries hold the bits in
rotated orders that begin with 21 bits each of their own.  Two differing bits cannot lie in all three beginnings, so
in one of the tries every linked pair still shares its node at depth 21: the error budget is nothing above that
depth and two bits from there on.  Below, pairs of nodes are traversed together: the bits in which their paths
differ are summed, and a pair is dropped as soon as the sum exceeds the budget.

A pair of nodes that holds few fingerprints is traversed within a task.  A larger one is split into the pairs of
its descendants four levels down, in as many rounds as it takes, so that no node has to fit into a task.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.base import U64, batch, numbers_of, prepare, query, slices, table, texts_of, written
from flowspark.llm.groups import components

WORDS = 3
SEED = 42
BITS = 64
ERRORS = 2  # differing bits that still link
SHARED = BITS // (ERRORS + 1)  # leading bits of a trie in which a linked pair must agree: 21
LEAF = 1 << 14  # fingerprints of a pair of nodes that a task traverses by itself
STEP = 4  # levels that a larger pair descends in one round
FRONTIER = 1 << 18  # pairs of nodes that a task works on at once
CHUNK = 4_000_000
HASHED = 1 << 16  # shingles whose bits are counted at once
FLIP = U64(1 << 63)  # longs are stored with this bit turned, so that their order is that of the unsigned numbers
ALL = U64(2**64 - 1)

NODE = ["trie", "depth", "u", "v"]
MEMBERS = "trie long, depth long, u long, v long, code long, id long"


def fingerprint(text: str) -> int:
    """Bits that are set in over half the hashes of a text's 3-word shingles; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z only are lowered, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends], ends[WORDS - 1 :] or [len(line) + 1]
    counts, one = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), HASHED):
        spans = zip(starts[at:], ends[at : at + HASHED], strict=False)
        hashes = np.array([one(line[s : e - 1], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in slices(batches, "text", CHUNK):
        found = np.array([fingerprint(t) for t in texts_of(b.column(1))], U64)
        yield batch(doc_id=b.column(0), fp=found.view(np.int64))


def _stored(codes: np.ndarray) -> np.ndarray:
    return (codes ^ FLIP).view(np.int64)


def _unsigned(column: pa.Array) -> np.ndarray:
    return numbers_of(column).view(U64) ^ FLIP


def _top(depth: np.ndarray) -> np.ndarray:
    """Masks of the leading ``depth`` bits."""
    depth = depth.astype(U64)
    return np.where(depth == 0, U64(0), ALL << ((U64(BITS) - depth) & U64(63)))


def _tries(distinct: DataFrame) -> DataFrame:
    """Every fingerprint in each trie, at the node of its leading bits."""
    tries = []
    for k in range(ERRORS + 1):
        turned = F.col("fp") if k == 0 else F.shiftleft("fp", k * SHARED).bitwiseOR(F.shiftrightunsigned("fp", BITS - k * SHARED))
        low = F.lit(-(1 << 63))
        node = turned.bitwiseAND(F.lit(-(1 << (BITS - SHARED)))).bitwiseXOR(low)
        tries.append(F.struct(F.lit(k).cast("long").alias("trie"), F.lit(SHARED).cast("long").alias("depth"), node.alias("u"), node.alias("v"), turned.bitwiseXOR(low).alias("code")))
    return distinct.select(F.explode(F.array(*tries)).alias("m"), "id").select("m.*", "id")


def _descend(batches):
    """Members of pairs of nodes -> members of the pairs ``STEP`` levels down that are within the budget."""
    masks = sorted(range(1 << STEP), key=lambda m: (m.bit_count(), m))
    for b in batches:
        trie, depth = numbers_of(b.column(0)), numbers_of(b.column(1))
        u, v, code = (_unsigned(b.column(k)) for k in (2, 3, 4))
        ids = numbers_of(b.column(5))
        below = np.minimum(depth + STEP, BITS)
        own = code & _top(below)
        first = (code & _top(depth)) == u
        other = np.where(first, v, u) | (own & ~_top(depth))
        left = ERRORS - np.bitwise_count(u ^ v).astype(np.int64)
        for m in masks:
            fits = np.flatnonzero((m.bit_count() <= left) & (m < (1 << (below - depth))))
            met = other[fits] ^ (U64(m) << (U64(BITS) - below[fits].astype(U64)))
            mine = own[fits]
            # Two nodes of one parent are a pair in the order of their codes; else the first side stays the first.
            ahead = np.where(u[fits] == v[fits], mine <= met, first[fits])
            yield batch(trie=trie[fits], depth=below[fits], u=_stored(np.where(ahead, mine, met)), v=_stored(np.where(ahead, met, mine)),
                        code=_stored(code[fits]), id=ids[fits])


def _leading(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> U64(s))
    return BITS - np.bitwise_count(x).astype(np.int64)


def _turn(codes: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place of each node's range (its codes sorted, equal above ``depth``) whose bit at ``depth`` is set."""
    bit = U64(1) << (U64(BITS - 1) - depth.astype(U64))
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        is_set = (codes[middle] & bit[open_]) != 0
        high[open_[is_set]] = middle[is_set]
        low[open_[~is_set]] = middle[~is_set] + 1
    return low


def traverse(codes: np.ndarray, pairs: np.ndarray):
    """Places of codes that differ in at most ``ERRORS`` bits, in arrays (2, n).

    ``codes``: sorted and distinct within every node; ``pairs``: rows (from, to, from, to), the ranges of two nodes, equal for
    a node with itself.  A node is taken at the depth where its codes first part, all bits above are told by any of them.
    """
    stack = [pairs[k : k + FRONTIER] for k in range(0, len(pairs), FRONTIER)]
    while stack:
        p = stack.pop()
        same = p[:, 0] == p[:, 2]
        alone, p = p[same & (p[:, 1] - p[:, 0] > 1)], p[~same]
        parts = []
        if len(alone):
            a, b = alone[:, 0], alone[:, 1]
            t = _turn(codes, a, b, _leading(codes[a] ^ codes[b - 1]))
            parts += [np.stack(x, axis=1) for x in ((a, t, a, t), (t, b, t, b), (a, t, t, b))]
        if len(p):
            depths = [_leading(codes[p[:, k]] ^ codes[p[:, k + 1] - 1]) for k in (0, 2)]
            known = np.minimum(*depths)
            differing = np.bitwise_count((codes[p[:, 0]] ^ codes[p[:, 2]]) & _top(known))
            near = differing <= ERRORS
            found = near & (known == BITS)
            if found.any():
                yield np.stack([p[found, 0], p[found, 2]])
            for k in (0, 2):
                at = near & ~found & (depths[k // 2] == known)
                if k == 2:
                    at &= depths[0] != known
                if at.any():
                    q = p[at]
                    t = _turn(codes, q[:, k], q[:, k + 1], known[at])
                    for c, d in ((q[:, k], t), (t, q[:, k + 1])):
                        r = q.copy()
                        r[:, k], r[:, k + 1] = c, d
                        parts.append(r)
        for x in parts:
            stack += [x[k : k + FRONTIER] for k in range(0, len(x), FRONTIER)]
        # Small pieces go on together, else every level of the trie would be one of its own.
        while len(stack) > 1 and len(stack[-1]) + len(stack[-2]) <= FRONTIER:
            stack.append(np.concatenate([stack.pop(), stack.pop()]))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> as many as it takes to connect the same ids, each to the smallest of them."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != label[label]).any():
            label = label[label]
    tied = label != np.arange(len(names))
    return names[label[tied]], names[tied]


def _join(batches):
    """Members sorted by pair of nodes and code -> links; no pair has more than ``LEAF`` members."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([numbers_of(b.column(k)) for k in range(6)])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        head = np.append(True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0))
        last = np.flatnonzero(head)[-1]
        held = rows[:, last:]
        yield from _links(rows[:, :last], np.flatnonzero(head[:last]))
    if held is not None:
        yield from _links(held, np.zeros(1, np.int64))


def _links(rows: np.ndarray, start: np.ndarray):
    if not rows.shape[1]:
        return
    codes, ids = rows[4].view(U64) ^ FLIP, rows[5]
    end = np.append(start[1:], rows.shape[1])
    depth, v = rows[1, start], rows[3, start].view(U64) ^ FLIP
    both = rows[2, start] != rows[3, start]
    # In a pair of two nodes the members of the second begin where the codes take its path.
    side = (codes & _top(np.repeat(depth, end - start))) == np.repeat(v, end - start)
    second = end - np.add.reduceat(side.astype(np.int64), start)
    pairs = np.stack([start, np.where(both, second, end), np.where(both, second, start), end], axis=1)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    for places in traverse(codes, pairs):
        a, b = stars(*ids[places])
        yield batch(a=a, b=b)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``fp``, ``id`` (longs, one row a fingerprint) -> (``a``, ``b``) that connect all ids within ``ERRORS`` bits."""
    members, small = _tries(distinct), []
    first = F.expr("(depth = 64 AND code = u) OR (depth < 64 AND shiftrightunsigned(code ^ u, CAST(64 - depth AS INT)) = 0)")
    while True:
        sizes = members.groupBy(*NODE).agg(F.count_if(first).alias("ahead"), F.count("*").alias("n"))
        large = written(sizes.where(F.col("n") > LEAF), "large-nodes")
        if large.isEmpty():
            break
        small.append(members.join(large, NODE, "left_anti"))
        open_ = large.where("u = v OR (ahead > 0 AND ahead < n)").select(*NODE)
        members = written(members.join(open_, NODE, "left_semi").mapInArrow(_descend, MEMBERS), "node-pairs")
    every = reduce(DataFrame.unionByName, [*small, members])
    return every.repartition(*NODE).sortWithinPartitions(*NODE, "code").mapInArrow(_join, "a long, b long")


def simhash_duplicates(documents: DataFrame) -> DataFrame:
    """Classes of documents linked by fingerprints that differ in at most two bits.

    ``documents``: ``doc_id`` long, ``text`` string; other columns are ignored.  One row a document comes back:
    ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest id reachable, itself included).

    Texts with fewer than three words are one shingle.  Null texts, empty texts and texts of white space have the
    fingerprint zero and are linked like any other.  A row without an id has a fingerprint, is linked with nothing, and
    its ``component_id`` is null.  Rows that repeat an id count as one document with the links of all of them.
    """
    docs = prepare(documents, "doc_id", "text")
    signed = written(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    named = signed.where("doc_id IS NOT NULL")
    distinct = written(named.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    repeated = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    tied = named.join(repeated.select("doc_id"), "doc_id", "left_semi").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = components(fingerprint_links(distinct).unionByName(tied))
    classes = distinct.join(labels, "id", "left").select("fp", F.coalesce("label", "id").alias("component"))
    return signed.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


@query("op13_simhash_near_dedup")
def simhash_query(spark, folder: str) -> DataFrame:
    return simhash_duplicates(table(spark, folder, "documents"))
