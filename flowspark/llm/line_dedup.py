"""Fuzzy line deduplication: one line of each group of similar lines stays.

Lines are compared by their sets of 8-character shingles, after lower-casing and joining white space.  Equal
lines fall together by their hash.  48 MinHash values in 12 bands of 4 bring similar lines together (a pair
is missed in 2 of 1,000 cases at a Jaccard similarity of 0.8, in 1 of 10,000 at 0.85), the sets of their shingles
confirm them, and distributed union-find keeps the first line of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.base import (
    GOLDEN, U64, Membership, batch, mix, numbers_of, prepare, query, seeds, slices, table, texts_of, written,
)
from flowspark.llm.groups import SKETCH, bucket_members, linked_components, sketch_columns

SHINGLE = 8
PERCENT = 80
BANDS, ROWS = 12, 4
CHUNK = 2_000_000
BLOCK = 256  # lines hashed together: their arrays stay in the processor's cache
REMEMBERED = 4_000_000  # shingles of lines that a task remembers while it confirms pairs
U32 = np.uint32
ODD = seeds(BANDS * ROWS, 1, U32) | U32(1)
ADD = seeds(BANDS * ROWS, 11, U32)


def plain_line(line: str) -> str:
    """Lower case, no white space at the ends and single spaces inside."""
    line = line.strip().lower()
    return " ".join(line.split()) if "  " in line or not line.isprintable() else line


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - 2**63


def _grams(codes: np.ndarray, base: int, kind) -> np.ndarray:
    """Polynomial hash of the eight characters that start at each place."""
    h, span, modulus = codes, 1, int(np.iinfo(kind).max) + 1
    while span < SHINGLE:
        h = h[:-span] * kind(base) + h[span:]
        base = base * base % modulus
        span *= 2
    return h


def _placed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all lines in one array, and each line's first and one-past-last shingle place."""
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), U32)
    ends = np.cumsum([len(x) for x in padded])
    starts = np.concatenate(([0], ends[:-1]))
    return codes, starts, ends - SHINGLE + 1


def band_keys(lines: list[str]) -> np.ndarray:
    """The band keys of each of the (non-empty) lines."""
    keys = np.zeros((len(lines), BANDS), U64)
    for at in range(0, len(lines), BLOCK):
        block = keys[at : at + BLOCK]
        codes, starts, stops = _placed(lines[at : at + BLOCK])
        h = _grams(codes * U32(0x9E3779B1), 0x85EBCA6B, U32)
        h ^= h >> U32(16)
        h *= U32(0x7FEB352D)
        h ^= h >> U32(15)
        h = np.append(h, U32(0))
        cuts = np.stack((starts, stops), 1).ravel()
        values = np.empty_like(h)
        for band in range(BANDS):
            key = np.full(len(block), band + 1, U64) * GOLDEN
            for row in range(ROWS):
                k = band * ROWS + row
                np.multiply(h, ODD[k], out=values)
                np.add(values, ADD[k], out=values)
                key = mix(key ^ np.minimum.reduceat(values, cuts)[::2].astype(U64))
            block[:, band] = key
    return keys.view(np.int64)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct 56-bit shingle hashes of each line.

    The hashes of a block of lines are sorted together, under the line's number in the block.
    """
    found = []
    for at in range(0, len(lines), BLOCK):
        codes, starts, stops = _placed(lines[at : at + BLOCK])
        h = mix(_grams(mix(codes.astype(U64) + GOLDEN), 0x2545F4914F6CDD1D, U64)) >> U64(8)
        sizes = stops - starts
        owner = np.repeat(np.arange(len(sizes), dtype=U64), sizes)
        places = np.arange(len(owner)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        items = np.sort(owner << U64(56) | h[places])
        fresh = np.ones(len(items), np.bool_)
        fresh[1:] = items[1:] != items[:-1]
        items = items[fresh]
        ends = np.cumsum(np.bincount((items >> U64(56)).astype(np.int64), minlength=len(sizes))).tolist()
        items = (items & U64(2**56 - 1)).view(np.int64)
        found += [items[a:b] for a, b in zip([0, *ends], ends)]
    return found


def _occurrences(batches):
    for b in slices(batches, "text", CHUNK):
        out = [[], [], []]
        for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
            for number, line in enumerate(text.split("\n")):
                if line := plain_line(line):
                    out[0].append(line_hash(line))
                    out[1].append(doc_id)
                    out[2].append(number)
        yield batch(id=pa.array(out[0], pa.int64()), doc_id=pa.array(out[1], pa.int64()), number=pa.array(out[2], pa.int64()))


def _distinct_lines(texts: list[str]) -> dict[int, str]:
    return {line_hash(x): x for t in texts for y in t.split("\n") if (x := plain_line(y))}


def _bands(batches):
    for b in slices(batches, "text", CHUNK):
        lines = _distinct_lines(texts_of(b.column(1)))
        if lines:
            keys = band_keys(list(lines.values()))
            yield batch(key=keys.ravel(), id=np.repeat(np.fromiter(lines, np.int64, len(lines)), BANDS))


def _wanted(test):
    """Distinct lines that the filter lets through."""

    def wanted(batches):
        for b in slices(batches, "text", CHUNK):
            lines = _distinct_lines(texts_of(b.column(1)))
            ids = np.fromiter(lines, np.int64, len(lines))
            keep = test(ids)
            if keep.any():
                kept = [x for x, k in zip(lines.values(), keep) if k]
                yield batch(id=ids[keep], line=pa.array(kept, pa.string()), **sketch_columns(shingle_sets(kept)))

    return wanted


def _confirm(percent: int):
    """Pairs of lines -> those whose sets have 100 * intersection >= percent * union."""

    def confirm(batches):
        known: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            ids, lines = [b.column(0).to_pylist(), b.column(1).to_pylist()], [b.column(2), b.column(3)]
            out = []
            for lo in range(0, b.num_rows, 500):
                if held > REMEMBERED:
                    known, held = {}, 0
                new = {ids[side][k]: (side, k) for side in (0, 1) for k in range(lo, min(lo + 500, b.num_rows)) if ids[side][k] not in known}
                if new:
                    known.update(zip(new, shingle_sets([lines[side][k].as_py() for side, k in new.values()])))
                    held += sum(len(known[i]) for i in new)
                out += [_similar(known[x], known[y], percent) for x, y in zip(ids[0][lo : lo + 500], ids[1][lo : lo + 500])]
            keep = pa.array(out, pa.bool_())
            yield batch(a=b.column(0).filter(keep), b=b.column(1).filter(keep))

    return confirm


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets have 100 * intersection >= percent * union?"""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def repeated_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Lines to remove: (``doc_id``, ``numbers``), the places (from 0) of a document's lines that do not stay.

    Of each component of similar lines the one with the smallest (document id, place) stays.  Blank lines
    are no lines to compare: they stay.  Lines shorter than a shingle equal only themselves.  Documents with a
    null id have no place in that order; their lines neither go nor make others go.  Rows that repeat an id
    are one document: a line at the same place in them is one line if the texts are equal, and the rows lose
    the same places.
    """
    docs = prepare(documents, "doc_id", "text").where("doc_id IS NOT NULL")
    seen = written(docs.mapInArrow(_occurrences, "id long, doc_id long, number long"), "lines")
    first = seen.groupBy("id").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    members = written(bucket_members(docs.mapInArrow(_bands, "key long, id long")), "line-members")
    ids = members.select("id").distinct()
    member = Membership(docs.sparkSession, ids)
    lines = docs.mapInArrow(_wanted(member.tester()), f"id long, line string, {SKETCH}")
    lines = written(lines.join(ids, "id", "left_semi").dropDuplicates(["id"]), "line-texts")
    labels, _ = linked_components(members, lines, percent, lambda pairs: _confirmed(pairs, lines, percent))
    labelled = first.join(labels, "id", "left").select("id", "first", F.coalesce("label", "id").alias("label"))
    stays = labelled.groupBy("label").agg(F.min("first").alias("stays"))
    owner = labelled.join(stays, "label").select("id", "stays")
    gone = seen.join(owner, "id").where(F.struct("doc_id", "number") != F.col("stays"))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def remove_lines(text: str, numbers: list[int]) -> str:
    gone = set(numbers)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def _cut(names: list[str]):
    def cut(batches):
        for b in slices(batches, "text", CHUNK):
            at = b.schema.get_field_index("text")
            texts = [
                t if t is None or not gone else remove_lines(t, gone)
                for t, gone in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())
            ]
            columns = [b.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def dedup_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with repeated lines cut out of ``text``; every row and all other columns stay.

    A document whose lines all go stays with the empty text.  Null texts stay null.
    """
    gone = repeated_lines(documents, percent).select(F.col("doc_id").alias("__id"), F.col("numbers").alias("__gone"))
    joined = documents.join(gone, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(_cut(documents.columns), documents.schema)


@query("op1_line_dedup")
def line_dedup_query(spark, folder: str) -> DataFrame:
    """Every document with its number of lines and the places of the lines that went."""
    documents = table(spark, folder, "documents")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    counted = documents.select("doc_id", lines.cast("long").alias("n_lines"))
    found = counted.join(repeated_lines(documents), "doc_id", "left")
    return found.select(
        "doc_id", "n_lines", F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("numbers", F.array().cast("array<bigint>")).alias("removed_lines"),
    )
