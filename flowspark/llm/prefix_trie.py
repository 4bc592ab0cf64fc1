"""The trie of conversation prefixes, read off sorted conversations by range minima.

Conversations are sorted as sequences of turns, so that the members of a prefix of depth d are an interval of rows
between which all longest common prefixes (LCPs) reach d.  A sparse table holds the minima of the LCPs over every
stretch of 2 ** k rows; with it each candidate prefix finds its left and its right end by binary search, alone and in any
order.  Counts, leaves and sizes are then differences of prefix sums over the interval.

The sorted rows are dealt into blocks by ranges of (sequence, id), so that neither a common beginning nor copies of
one conversation gather in a task.  A prefix whose members lie in several blocks leaves one row of sums in each of them;
these few are added up, and what lies within a block takes its parent from them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.base import batch, buckets_for, numbers_of, prepare, query, table, written

FAMILY = 5  # conversations c - c % 5 ... lend their first turns to the others
MOST_SHARED = 8
DIGEST = 16  # bytes that stand for a turn
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 17  # a block is closed when it has either
BUCKET = 8_000_000  # bytes of rebuilt conversations in a sorted bucket
PIECE = 4096  # ids of a row where a list of ids goes over several blocks
NO_IDS = hashlib.sha256().hexdigest()

BLOCKS = "block long, ids binary, lengths binary, turns binary, sizes binary, first binary, last binary"
WITHIN, ACROSS, IDS = 0, 1, 2  # kinds of a block's rows
NODES = (
    "kind int, block long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, bytes_all long, bytes_new long, "
    "bytes_above long, ends string, parent long, side int, key binary, parent_key binary, at_left boolean, at_right boolean, piece long, ids binary"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """Rebuilt conversations: ``conv_id``, ``turns`` (16 bytes a turn) and ``sizes`` (bytes of each turn's text)."""
    rows = prepare(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    own = written(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own")), "conversations")
    lent = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("lender"), F.slice("own", 1, MOST_SHARED).alias("lent"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    both = own.withColumns({"lender": F.expr(f"conv_id - conv_id % {FAMILY}"), "h": taken}).join(lent, "lender", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.when(F.col("lent").isNull(), rest).otherwise(F.concat(F.slice("lent", F.lit(1), F.col("h")), rest))
    both = both.select("conv_id", whole.alias("s"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("s.digest"), "")).alias("turns"), F.col("s.size").alias("sizes"))


def _blocks(most_rows: int, most_turns: int):
    """Sorted conversations -> blocks of a bucket, numbered in their order."""

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        names, sizes = own.column(1).to_pylist(), own.column(2).combine_chunks().flatten()
        parts = {
            "ids": numbers_of(own.column(0)), "lengths": np.array([len(t) // DIGEST for t in names], np.int64),
            "turns": np.frombuffer(b"".join(names), np.uint8), "sizes": np.array(sizes.to_numpy(zero_copy_only=False), np.int64),
        }
        return batch(block=[number], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in parts.items()},
                     first=pa.array(names[:1], pa.binary()), last=pa.array(names[-1:], pa.binary()))

    def blocks(batches):
        number, held, rows, turns = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            counts = np.cumsum([len(t) // DIGEST for t in b.column(1).to_pylist()])
            start = 0
            while start < b.num_rows:
                before = counts[start - 1] if start else 0
                full = int(np.searchsorted(counts, before + most_turns - turns)) + 1
                stop = min(start + most_rows - rows, full, b.num_rows)
                held.append(b.slice(start, stop - start))
                rows, turns, start = rows + stop - start, turns + int(counts[stop - 1] - before), stop
                if rows >= most_rows or turns >= most_turns:
                    yield block(number, held)
                    number, held, rows, turns = number + 1, [], 0, 0
        if held:
            yield block(number, held)

    return blocks


def _turns(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint64).reshape(-1, 2)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(apart[0]) if len(apart) else n


def common_prefixes(turns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it; 0 for the first."""
    start = np.cumsum(lengths) - lengths
    most = np.zeros(len(lengths), np.int64)
    most[1:] = np.minimum(lengths[1:], lengths[:-1])
    place = np.cumsum(most) - most
    row = np.repeat(np.arange(len(lengths)), most)
    at = np.arange(len(row)) - place[row]
    apart = np.flatnonzero((turns[start[row] + at] != turns[start[row - 1] + at]).any(axis=1))
    first = np.append(apart, len(row))[np.searchsorted(apart, place)]
    return np.minimum(most, first - place)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of values[j : j + 2 ** k] at place j."""
    levels = [values]
    while len(levels[-1]) > (half := 1 << (len(levels) - 1)):
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def range_minima(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum over first..last, both included, by two stretches that may overlap."""
    k = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][first[at]], levels[level][last[at] - (1 << level) + 1])
    return out


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with each row; level k at j: the least LCP among rows j .. j + 2 ** k."""
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        least, step = levels[k], 1 << k
        if not len(least):
            continue
        fits = (left >= step) & (least[np.maximum(left - step, 0)] >= depth)
        left[fits] -= step
        fits = (right < len(least)) & (least[np.minimum(right, len(least) - 1)] >= depth)
        right[fits] += step
    return left, right


def _path_keys(turns: np.ndarray, depth: int) -> list[bytes]:
    """A key for each prefix of a sequence, down to ``depth``."""
    running, keys = xxhash.xxh3_128(), []
    for k in range(depth + 1):
        keys.append(running.digest() + k.to_bytes(4, "big"))
        if k < depth:
            running.update(turns[k].tobytes())
    return keys


def block_nodes(block: int, ids: np.ndarray, lengths: np.ndarray, turns: np.ndarray, sizes: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> list[pa.RecordBatch]:
    """The nodes of a block of sorted conversations; ``before`` and ``after`` are the sequences next to it."""
    n = len(ids)
    start = np.cumsum(lengths) - lengths
    own = [turns[start[k] : start[k] + lengths[k]] for k in (0, n - 1)]
    lcp = np.append(common_prefixes(turns, lengths), -1)  # lcp[i]: with the row before; -1: there is none
    lcp[0] = -1 if before is None else _common(before, own[0])
    lcp[n] = -1 if after is None else _common(own[1], after)
    levels, least_ids = sparse_table(lcp[1:n]), sparse_table(ids)

    # Candidates: whole conversations and branching points, where the block's outer neighbours branch off too.
    row = np.concatenate([np.arange(n), np.arange(1, n), [0, 0, n - 1]])
    depth = np.concatenate([lengths, lcp[1:n], [0, max(lcp[0], 0), max(lcp[n], 0)]])
    left, right = extents(levels, row, depth)
    _, one = np.unique(np.stack([left, -right, depth]), axis=1, return_index=True)  # sorted by interval, then depth
    left, right, depth = left[one], right[one], depth[one]
    # Depths that no candidate has lie on a path without branches and share the interval of the next candidate below.
    inner = lcp.copy()
    inner[[0, n]] = -1
    least = np.maximum(inner[left], inner[right + 1]) + 1
    again = np.append(False, (left[1:] == left[:-1]) & (right[1:] == right[:-1]))
    least[again] = depth[:-1][again[1:]] + 1

    top_left, top_right = extents(levels, left, least - 1)  # the parent of each path's upper end
    low_id, parent_id = range_minima(least_ids, left, right), range_minima(least_ids, top_left, top_right)
    parent_side = np.where((top_left == 0) & (least - 1 <= lcp[0]), 1, np.where((top_right == n - 1) & (least - 1 <= lcp[n]), 2, 0))
    parent_side[least == 0] = 0  # the root has none

    path = np.repeat(np.arange(len(depth)), depth - least + 1)
    level = np.arange(len(path)) - np.repeat(np.cumsum(depth - least + 1) - (depth - least + 1), depth - least + 1) + least[path]
    lo, hi, bottom = left[path], right[path], level == depth[path]
    at_left, at_right = (lo == 0) & (level <= lcp[0]), (hi == n - 1) & (level <= lcp[n])
    across = at_left | at_right

    # Children start where a row shares exactly this depth with the row before and goes on.
    branch = np.flatnonzero((lengths[1:] > lcp[1:n])) + 1
    places = np.sort(lcp[branch] * (n + 1) + branch)
    children = np.where(bottom, np.searchsorted(places, level * (n + 1) + hi, "right") - np.searchsorted(places, level * (n + 1) + lo, "right"), 0)
    children += (lengths[lo] > level) & (lcp[lo] <= level)
    is_leaf = np.append(0, np.cumsum(lcp[1:] < lengths))
    cumulated = np.zeros(len(sizes) + n, np.int64)  # bytes of each row's first k turns, from k = 0
    cumulated[np.arange(len(sizes)) + np.repeat(np.arange(n), lengths) + 1] = sizes
    cumulated = np.cumsum(cumulated)
    heads = start + np.arange(n)
    cumulated -= np.repeat(cumulated[heads], lengths + 1)
    total = cumulated[heads + lengths]
    every = np.append(0, np.cumsum(total))
    fresh = np.append(0, np.cumsum(total - cumulated[heads + np.maximum(lcp[:n], 0)]))
    above = cumulated[heads[lo] + np.maximum(level - 1, 0)]
    new = fresh[hi + 1] - np.where(at_left, fresh[lo], fresh[lo + 1]) + np.where(at_left, 0, total[lo] - above)

    # Conversations that end at a node are its first rows.
    same = np.append(False, (lcp[1:n] == lengths[1:]) & (lengths[1:] == lengths[:-1]))
    stops = np.append(np.flatnonzero(~same)[1:], n)
    run_end = stops[np.searchsorted(stops, np.arange(n), "right")]
    goes_back = before is not None and len(before) == lengths[0] == lcp[0]
    goes_on = after is not None and len(after) == lengths[n - 1] == lcp[n]
    names = [str(i).encode() for i in ids.tolist()]
    ends: list[str | None] = [None] * len(path)
    keys = [_path_keys(own[0], lcp[0]), _path_keys(own[1], lcp[n])]
    pieces: list[tuple[bytes, int, bytes]] = []
    for k in np.flatnonzero(bottom & (lengths[lo] == level)).tolist():
        a, b = int(lo[k]), int(run_end[lo[k]])
        if (a == 0 and goes_back) or (b == n and goes_on):
            key = keys[0 if at_left[k] else 1][level[k]]
            pieces += [(key, at, b",".join(names[at : min(at + PIECE, b)])) for at in range(a, b, PIECE)]
        else:
            ends[k] = hashlib.sha256(b",".join(names[a:b])).hexdigest()

    upper = level == least[path]
    common = dict(depth=level, conv_id=low_id[path], n_convs=hi - lo + 1, n_children=children, n_leaves=is_leaf[hi + 1] - is_leaf[lo],
                  bytes_all=every[hi + 1] - every[lo], bytes_new=new, bytes_above=above)
    here, out = np.flatnonzero(~across), []
    side = np.where(upper, parent_side[path], 0)[here]
    parent = np.where(upper, parent_id[path], low_id[path])[here]
    unknown = (side > 0) | (level[here] == 0)
    out.append(_rows(len(here), kind=np.full(len(here), WITHIN), block=np.full(len(here), block), **{c: v[here] for c, v in common.items()},
                     ends=[ends[k] for k in here.tolist()], parent=pa.array(parent, mask=unknown), side=side))
    there = np.flatnonzero(across)
    own_keys = [keys[0 if at_left[k] else 1] for k in there.tolist()]
    out.append(_rows(len(there), kind=np.full(len(there), ACROSS), block=np.full(len(there), block), **{c: v[there] for c, v in common.items()},
                     ends=[ends[k] for k in there.tolist()], key=[own[level[k]] for own, k in zip(own_keys, there)],
                     parent_key=[own[level[k] - 1] if level[k] else None for own, k in zip(own_keys, there)],
                     at_left=at_left[there], at_right=at_right[there]))
    if pieces:
        key, piece, text = zip(*pieces)
        out.append(_rows(len(key), kind=np.full(len(key), IDS), block=np.full(len(key), block), key=list(key), piece=list(piece), ids=list(text)))
    return out


ARROW = pa.schema([
    (name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind])
    for name, kind in (c.split() for c in NODES.split(","))
])


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch with every column of ``NODES``, null where none is given."""
    arrays = [pa.array(c).cast(f.type) if (c := columns.get(f.name)) is not None and not isinstance(c, list) else pa.array(c if c is not None else [None] * n, f.type) for f in ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _nodes(rows: pa.Table) -> pa.Table:
    out = []
    for r in rows.to_pylist():
        ids, lengths, sizes = (np.frombuffer(r[c], np.int64) for c in ("ids", "lengths", "sizes"))
        before, after = (None if r[c] is None else _turns(r[c]) for c in ("before", "after"))
        out += block_nodes(r["block"], ids, lengths, _turns(r["turns"]), sizes, before, after)
    return pa.Table.from_batches(out, ARROW)


def _digests(batches):
    """Pieces of lists of ids, sorted by key and place -> SHA-256 of each list; one hash at a time is open."""
    key, running = None, None
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    yield batch(key=pa.array([key], pa.binary()), ends_across=[running.hexdigest()])
                key, running = k, hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
    if key is not None:
        yield batch(key=pa.array([key], pa.binary()), ends_across=[running.hexdigest()])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    ``conversations``: ``conv_id`` and ``turn`` long, ``role`` and ``text`` string; other columns are ignored.  Conversation c is
    rebuilt from the first h turns of conversation c - c % 5 and its own turns after its first h, h = crc32(c) % 9.  Rows, for
    each distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by ``turn``, null first, equal ones by a digest of role and text; null role and text count as empty.
    Rows without a ``conv_id`` are left out.  An empty table has no node, not even the root.  A conversation is
    one row of 24 bytes a turn; equal sequences are told by 128-bit digests.  The digest of ids is one SHA-256
    over all members that end at a node: where they go over several blocks, it is taken as a stream.
    """
    rebuilt = written(sequences(conversations), "rebuilt")
    dealt = rebuilt.repartitionByRange(buckets_for(rebuilt, BUCKET), "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    blocks = written(dealt.mapInArrow(_blocks(BLOCK_ROWS, BLOCK_TURNS), BLOCKS), "sorted-blocks")
    order = Window.orderBy("block")  # one short row a block
    near = blocks.select("block", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    nodes = written(blocks.drop("first", "last").join(near, "block").groupBy("block").applyInArrow(_nodes, NODES), "trie-nodes")

    parts = nodes.where(F.col("kind") == ACROSS)
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "bytes_all", "bytes_new")]
    merged = parts.groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *summed,
                                      F.max("bytes_above").alias("bytes_above"), F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"))
    lists = nodes.where(F.col("kind") == IDS).repartition("key").sortWithinPartitions("key", "block", "piece").select("key", "ids")
    lists = lists.mapInArrow(_digests, "key binary, ends_across string")
    merged = written(merged.join(lists, "key", "left").withColumn("ends", F.coalesce("ends_across", "ends")), "prefixes-across-blocks")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    across = merged.join(above, "parent_key", "left")

    sides = F.explode(F.array_compact(F.array(F.when(F.col("at_left"), 1), F.when(F.col("at_right"), 2)))).alias("side")
    border = parts.select("block", "depth", sides, "key").join(merged.select("key", F.col("conv_id").alias("found")), "key")
    border = border.select("block", "side", (F.col("depth") + 1).alias("depth"), "found")
    inside = nodes.where(F.col("kind") == WITHIN)
    resolved = inside.where("side > 0").join(border, ["block", "side", "depth"]).withColumn("parent", F.col("found"))

    def shaped(df: DataFrame) -> DataFrame:
        saved = F.col("bytes_all") - F.col("n_convs") * F.col("bytes_above") - F.col("bytes_new")
        return df.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                         saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))

    return shaped(inside.where("side = 0")).unionByName(shaped(resolved)).unionByName(shaped(across))


@query(
    "op11_conversation_prefix_trie",
    """
    WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM own),
    rebuilt AS (SELECT h.conv_id, list_concat(coalesce(l.s, [])[1:h.h], h.s[h.h + 1:]) AS s FROM h LEFT JOIN own AS l ON l.conv_id = h.conv_id - h.conv_id % 5),
    prefix AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
    node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefix GROUP BY p, d),
    child AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
    full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(node.p[node.d].t) END AS own_saved
      FROM node LEFT JOIN child ON child.d = node.d AND child.p = node.p),
    up AS (SELECT p[1:k] AS p, k AS d, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(own_saved) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_node) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves,
      CAST(up.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM full_node AS n JOIN up ON up.d = n.d AND up.p = n.p LEFT JOIN node AS q ON q.d = n.d - 1 AND q.p = n.p[1:n.d - 1] AND n.d > 0
    """,
)
def prefix_trie_query(spark, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
