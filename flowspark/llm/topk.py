"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are cut into four groups of components; each group is a list of partial scores.  Phase one gathers the k
best entries of every list and the lists' minima: the k-th best lower bound t is safe.  An answer must reach the
uniform cutoff, its list's minimum plus a quarter of what t exceeds all minima by, in one list at least.  Phase two
collects the entries at or above the cutoffs and raises t; entries whose upper bound stays below t are out.
Phase three resolves the scores of the rest exactly.

The vectors lie in blocks, the queries (a stated set) in smaller blocks that go to every block of vectors; partial
results are merged in a tree, so that no task gathers more than a few blocks' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.base import batch, prepare, query, table, written

BLOCK = 4096
QUERIES_EACH = 256
LISTS = 4
FAN = 32  # partial results that one merge takes in
EXACT = float(2**53)
LOW = -(2**62)


def _pack_block(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of floor(64 x); missing components count as 0."""
    vectors = rows.column("vector").to_pylist()
    width = max((len(v) for v in vectors), default=0)
    matrix = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        matrix[k, : len(v)] = v
    return np.array(rows.column("vec_id").to_numpy(zero_copy_only=False), np.int64), np.floor(64 * matrix)


def _blocks(batches):
    """All rows of a partition as blocks, whatever the size of the batches; the second key keeps several blocks of one partition apart."""
    part, held, rows = 0, [], 0

    def block():
        ids, matrix = _pack_block(pa.Table.from_batches(held))
        return batch(block=[held[0].column("block")[0].as_py()], part=[part], n=[len(ids)], ids=pa.array([ids.tobytes()], pa.binary()),
                     matrix=pa.array([matrix.tobytes()], pa.binary()))

    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, BLOCK - rows))
            rows += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if rows == BLOCK:
                yield block()
                part, held, rows = part + 1, [], 0
    if held:
        yield block()


def _queries(every: int):
    def queries(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                matrix = np.frombuffer(r["matrix"]).reshape(len(ids), -1)
                at = np.flatnonzero(ids % every == 0)
                yield batch(block=np.full(len(at), r["block"], np.int64), part=np.full(len(at), r["part"], np.int64), place=at, query_id=ids[at],
                            vector=pa.array([matrix[k].tobytes() for k in at], pa.binary()))

    return queries


def _query_block(rows: pa.Table) -> pa.Table:
    width = max(len(v) for v in rows.column("vector").to_pylist()) // 8
    matrix = np.zeros((len(rows), width))
    for k, v in enumerate(rows.column("vector").to_pylist()):
        matrix[k, : len(v) // 8] = np.frombuffer(v)
    home = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("block", "part", "place", "query_id")])
    return pa.table({"lot": [rows.column("lot")[0].as_py()], "queries": pa.array([len(rows)], pa.int64()), "home": pa.array([home.tobytes()], pa.binary()),
                     "asked": pa.array([matrix.tobytes()], pa.binary())})


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``a`` and rows of ``b``; beyond a long they stop at its ends."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a).dot(whole(b).T)
    return np.clip(out, -(2**61), 2**61).astype(np.int64)


def _partials(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partial scores [list, query, vector], vector ids, query ids and the mask of queries' own rows."""
    ids = np.frombuffer(r["ids"], np.int64)
    matrix = np.frombuffer(r["matrix"]).reshape(len(ids), -1)
    home = np.frombuffer(r["home"], np.int64).reshape(4, -1)
    asked = np.frombuffer(r["asked"]).reshape(home.shape[1], -1)
    width = min(matrix.shape[1], asked.shape[1])  # what one of them lacks counts as 0
    cuts = np.linspace(0, width, LISTS + 1).astype(int)
    parts = np.stack([_times(asked[:, a:z], matrix[:, a:z]) for a, z in zip(cuts[:-1], cuts[1:])])
    own = np.zeros(parts.shape[1:], np.bool_)
    here = np.flatnonzero((home[0] == r["block"]) & (home[1] == r["part"]))
    own[here, home[2][here]] = True
    return parts, ids, home[3], own


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row."""
    k = min(k, values.shape[1])
    return np.argpartition(-values, k - 1, axis=1)[:, :k] if k < values.shape[1] else np.broadcast_to(np.arange(k), values.shape).copy()


def _out(lot: int, group: int, data: np.ndarray) -> pa.RecordBatch:
    shape = np.array(data.shape, np.int64)
    return batch(lot=pa.array([lot], pa.int64()), group=pa.array([group], pa.int64()), shape=pa.array([shape.tobytes()], pa.binary()),
                 data=pa.array([np.ascontiguousarray(data, np.int64).tobytes()], pa.binary()))


OUT = "lot long, group long, shape binary, data binary"


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(d, np.int64).reshape(np.frombuffer(s, np.int64)) for s, d in zip(rows.column("shape").to_pylist(), rows.column("data").to_pylist())]


def _phase_one(k: int):
    """For each query and list: the k best entries (row name, partial score) and, as the last entry, the minimum."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                parts, ids, _, own = _partials(r)
                name = (r["block"] << 36) + (r["part"] << 20) + np.arange(len(ids))
                data = np.full((parts.shape[1], LISTS, k + 1, 2), LOW, np.int64)
                for j in range(LISTS):
                    data[:, j, k, 1] = parts[j].min(axis=1, initial=2**62)
                    p = np.where(own, LOW, parts[j])
                    at = _best(p, k)
                    value = np.take_along_axis(p, at, 1)
                    data[:, j, : at.shape[1], 0] = np.where(value == LOW, LOW, name[at])
                    data[:, j, : at.shape[1], 1] = value
                yield _out(r["lot"], r["group"], data)

    return run


def _merge_lists(rows: pa.Table) -> pa.Table:
    arrays = _arrays(rows)
    k = arrays[0].shape[2] - 1
    every = np.concatenate([a[:, :, :k] for a in arrays], axis=2)
    order = np.argsort(-every[..., 1], axis=2, kind="stable")[:, :, :k]
    best = np.take_along_axis(every, order[..., None], axis=2)
    least = np.min(np.stack([a[:, :, k:] for a in arrays]), axis=0)
    least[..., 0] = LOW
    return pa.Table.from_batches([_out(rows.column("lot")[0].as_py(), rows.column("group")[0].as_py(), np.concatenate((best, least), axis=2))])


def _cutoffs(k: int):
    """Merged lists -> for each query t, the cutoff of each list and the minimum of each list."""

    def run(batches):
        for b in batches:
            for lot, lists in zip(b.column("lot").to_pylist(), _arrays(b)):
                data = np.full((len(lists), 1 + 2 * LISTS), LOW, np.int64)
                for q, own in enumerate(lists):
                    least = own[:, k, 1]
                    known: dict[int, int] = {}
                    for j in range(LISTS):
                        for name, value in own[j, :k]:
                            if name != LOW:
                                known[name] = known.get(name, int(least.sum())) + int(value - least[j])
                    data[q, 1 + LISTS :] = least
                    if len(known) >= k:
                        data[q, 0] = sorted(known.values())[-k]
                        data[q, 1 : 1 + LISTS] = least + (data[q, 0] - least.sum()) // LISTS
                yield _out(lot, 0, data)

    return run


def _bounds(parts: np.ndarray, limits: np.ndarray, own: np.ndarray):
    """Which entries any list sends, and the lower and upper bounds of their scores."""
    cutoff = limits[:, 1 : 1 + LISTS].T[:, :, None]
    least = limits[:, 1 + LISTS : 1 + 2 * LISTS].T[:, :, None]
    sent = parts >= cutoff
    lower = np.where(sent, parts, least).sum(axis=0)
    upper = np.where(sent, parts, cutoff).sum(axis=0)
    return sent.any(axis=0) & ~own, lower, upper


def _phase_two(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                parts, _, _, own = _partials(r)
                limits = np.frombuffer(r["limits"], np.int64).reshape(parts.shape[1], -1)
                sent, lower, _ = _bounds(parts, limits, own)
                lower = np.where(sent, lower, LOW)
                data = np.full((len(lower), k, 1), LOW, np.int64)
                at = _best(lower, k)
                data[:, : at.shape[1], 0] = np.take_along_axis(lower, at, 1)
                yield _out(r["lot"], r["group"], data)

    return run


def _phase_three(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                parts, ids, _, own = _partials(r)
                limits = np.frombuffer(r["limits"], np.int64).reshape(parts.shape[1], -1)
                sent, _, upper = _bounds(parts, limits, own)
                raised = np.frombuffer(r["raised"], np.int64).reshape(parts.shape[1], -1)[:, -1:]
                open_ = sent & (upper >= np.maximum(limits[:, :1], raised))
                data = np.full((len(own), k, 2), LOW, np.int64)
                for q in range(len(own)):
                    at = np.flatnonzero(open_[q])
                    score = parts[:, q, at].sum(axis=0)
                    order = np.lexsort((ids[at], -score))[:k]
                    data[q, : len(order), 0], data[q, : len(order), 1] = score[order], ids[at][order]
                yield _out(r["lot"], r["group"], data)

    return run


def _merge_best(rows: pa.Table) -> pa.Table:
    """The k best of each query: by the first value downwards, then the second upwards."""
    arrays = _arrays(rows)
    k = arrays[0].shape[1]
    every = np.concatenate(arrays, axis=1)
    order = np.lexsort((every[..., -1], -every[..., 0]), axis=1)[:, :k]
    return pa.Table.from_batches([_out(rows.column("lot")[0].as_py(), rows.column("group")[0].as_py(), np.take_along_axis(every, order[..., None], axis=1))])


def _merged(parts: DataFrame, blocks: int, merge) -> DataFrame:
    """Merge the blocks' results in a tree until each lot of queries has one."""
    while True:
        blocks = -(-blocks // FAN)
        parts = parts.withColumn("group", F.expr(f"group div {FAN}")).groupBy("lot", "group").applyInArrow(merge, OUT)
        if blocks <= 1:
            return parts


def _answers(batches):
    for b in batches:
        for r in b.to_pylist():
            shape = np.frombuffer(r["shape"], np.int64)
            data = np.frombuffer(r["data"], np.int64).reshape(shape)
            ids = np.frombuffer(r["home"], np.int64).reshape(4, -1)[3]
            q, place = np.nonzero(data[..., 0] != LOW)
            yield batch(query_id=ids[q], rank=pa.array(place + 1, pa.int32()), vec_id=data[q, place, 1], score=data[q, place, 0])


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each row whose id is divisible by ``every``.

    ``vectors``: ``vec_id`` long, ``embedding`` array of numbers; other columns are ignored.  Components x become
    floor(64 x).  Rows: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller ``vec_id``; with
    fewer than ``k`` other rows all of them.  Null vectors, vectors with a null or non-finite component and rows
    without an id take no part.  Where lengths differ, missing components count as 0.  A row that repeats an id
    is a row of its own: it is asked for, and it answers the other.
    """
    rows = prepare(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("vector", finite))
    dealt = max(1, -(-rows.count() // BLOCK))
    blocks = rows.repartition(dealt).withColumn("block", F.spark_partition_id().cast("long"))
    blocks = written(blocks.mapInArrow(_blocks, "block long, part long, n long, ids binary, matrix binary"), "vector-blocks")
    asked = blocks.mapInArrow(_queries(every), "block long, part long, place long, query_id long, vector binary")
    asked = written(asked, "queries")
    lots = max(1, -(-asked.count() // QUERIES_EACH))
    lot = F.pmod(F.xxhash64("block", "part", "place"), F.lit(lots)).alias("lot")
    asked = asked.select(lot, "block", "part", "place", "query_id", "vector")
    asked = written(asked.groupBy("lot").applyInArrow(_query_block, "lot long, queries long, home binary, asked binary"), "query-lots")

    # The optimizer takes a table's size for what is exploded from it, and a file's size for what is packed in it: a broadcast
    # by those would bring lots x blocks to the driver.  So every join is a merge.
    def work(lots_with: DataFrame) -> DataFrame:
        everywhere = lots_with.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)).cast("array<long>")))
        return everywhere.join(blocks.hint("merge"), "block").withColumn("group", F.col("block"))

    lists = _merged(work(asked).mapInArrow(_phase_one(k), OUT), dealt, _merge_lists)
    limits = lists.mapInArrow(_cutoffs(k), OUT).select("lot", F.col("data").alias("limits"))
    asked_2 = written(asked.join(limits.hint("merge"), "lot"), "cutoffs")
    raised = _merged(work(asked_2).mapInArrow(_phase_two(k), OUT), dealt, _merge_best)
    asked_3 = written(asked_2.join(raised.select("lot", F.col("data").alias("raised")).hint("merge"), "lot"), "raised-cutoffs")
    best = _merged(work(asked_3).mapInArrow(_phase_three(k), OUT), dealt, _merge_best)
    best = best.join(asked.select("lot", "home").hint("merge"), "lot").select("home", "shape", "data")
    return best.mapInArrow(_answers, "query_id long, rank int, vec_id long, score long")


@query(
    "op4_exact_top_k",
    """
    WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def top_k_query(spark, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
