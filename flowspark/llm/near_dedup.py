"""Near-duplicate documents by MinHash with tensored banding.

Two collections of short keys (each three MinHash values) are computed; a table key joins one key of the first
with one of the second, so 10 + 10 keys give 100 tables for 60 MinHash values in place of 600.  Two documents meet
if they agree in a key of either collection: at a Jaccard similarity of 0.85 that fails in 15 of 100,000 cases.  A
smaller threshold gets more short keys, so that no more pairs are missed at it: 2 x 14 at 0.8.
Pairs that meet are confirmed on their full shingle sets.
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
from flowspark.llm.groups import SKETCH, bucket_members, components, linked_components, sketch_columns

WORDS = 5
PERCENT = 85
VALUES = 3  # MinHash values in a short key
MISSED = 15e-5  # share of pairs at the threshold that may meet in no table
CHUNK = 4_000_000
VOCABULARY = 200_000  # word hashes a task remembers before it starts anew
U32 = np.uint32


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; fewer words are one shingle, none gives none."""
    found = text.encode().lower().split()  # bytes: A-Z only are lowered, and white space is 0x20 and 0x09-0x0D
    if not found:
        return np.zeros(0, U64)
    codes = np.fromiter(map(words.__getitem__, found), U64, len(found))
    if len(codes) < WORDS:
        h = np.full(1, len(codes), U64) * GOLDEN
        for c in codes:
            h = mix(h ^ c) * GOLDEN
        return h
    h = codes[: len(codes) - WORDS + 1]
    for k in range(1, WORDS):
        h = mix(h * GOLDEN) ^ codes[k : len(codes) - WORDS + 1 + k]
    return np.unique(mix(h))


def keys_for(percent: int) -> int:
    """Short keys in each of the two collections: 10 at 85 percent, 14 at 80."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie above 0 and not above 100.")
    keys, apart = 1, 1 - (percent / 100) ** VALUES
    while 2 * apart**keys > MISSED:
        keys += 1
    return keys


def constants(keys: int) -> tuple[np.ndarray, np.ndarray]:
    return seeds(2 * keys * VALUES, 8, U32)[:, None] | U32(1), seeds(2 * keys * VALUES, 88, U32)[:, None]


def short_keys(shingles: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The short keys of a set: triples of MinHash values, hashed with their number."""
    codes = (shingles >> U64(32)).astype(U32)
    low = np.full(len(odd), np.iinfo(U32).max, U32)
    for at in range(0, len(codes), 5_000):
        low = np.minimum(low, (codes[at : at + 5_000] * odd + add).min(axis=1))
    low = low.reshape(-1, VALUES).astype(U64)
    h = np.arange(len(low), dtype=U64) * GOLDEN
    for k in range(VALUES):
        h = mix(h ^ mix(low[:, k]))
    return h


def _set_print(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _signatures(count: int):
    def signatures(batches):
        words, (odd, add) = _WordHashes(), constants(count)
        for b in slices(batches, "text", CHUNK):
            n, prints, keys = [], [], []
            for text in texts_of(b.column(1)):
                s = shingle_set(text, words)
                n.append(len(s))
                prints.append(_set_print(s) if len(s) else None)
                keys.append(short_keys(s, odd, add).view(np.int64) if len(s) else None)
            yield batch(doc_id=b.column(0), n_shingles=pa.array(n, pa.int64()), print=pa.array(prints, pa.int64()),
                        keys=pa.array(keys, pa.list_(pa.int64())))

    return signatures


def _sets(test):
    def sets(batches):
        words = _WordHashes()
        for b in slices(batches, "text", CHUNK):
            ids = numbers_of(b.column(0))
            keep = np.flatnonzero(test(ids))
            texts = texts_of(b.column(1).take(pa.array(keep)))
            found = [shingle_set(t, words).view(np.int64) for t in texts]
            yield batch(id=ids[keep], items=pa.array(found, pa.list_(pa.int64())), **sketch_columns(found))

    return sets


def _tables(count: int):
    """Table keys: every short key of the first collection with every one of the second."""

    def tables(batches):
        for b in batches:
            ids = numbers_of(b.column(0))
            out_key, out_id = [], []
            for i, keys in zip(ids, b.column(1).to_pylist()):
                pairs = np.array(keys, np.int64).reshape(-1, 2)  # number of the short key, its value
                number, value = pairs[:, 0], pairs[:, 1].view(U64)
                first, second = value[number < count], value[number >= count]
                out_key.append(mix(first[:, None] * GOLDEN ^ mix(second)[None, :]).ravel().view(np.int64))
                out_id.append(np.full(len(out_key[-1]), i))
            if out_key:
                yield batch(key=np.concatenate(out_key), id=np.concatenate(out_id))

    return tables


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets have 100 * intersection >= percent * union; ``sets``: ``id``, ``items`` without repeats."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").where(F.size("x") > 0).join(right, "b")
    m, n = F.size("x"), F.size("y")
    both = both.where((100 * F.least(m, n) >= percent * F.greatest(m, n)) & (n > 0))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (m + n - shared)).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by shingle sets with 100 * intersection >= percent * union.

    ``documents``: ``doc_id`` long, ``text`` string; other columns are ignored.  One row a document comes back:
    ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable, itself included) and ``kept``.

    Documents with equal sets fall together first and go on as one.  Null and empty texts have no shingle and
    are linked with nothing.  A null id is linked with nothing: its ``component_id`` is null and it is kept.
    Rows that repeat an id count as one document with the links of all of them.
    """
    docs = prepare(documents, "doc_id", "text")
    count = keys_for(percent)
    signed = written(docs.mapInArrow(_signatures(count), "doc_id long, n_shingles long, print long, keys array<long>"), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    first = named.groupBy("print").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys"))
    first = written(first, "distinct-sets")
    copies = named.join(first.select("print", "id"), "print").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    # A short key that no other set has cannot be part of a shared table key.
    short = first.select("id", F.posexplode("keys").alias("number", "key"))
    shared = bucket_members(short.select("key", "id")).select("key", "id")
    numbered = written(shared.join(short, ["key", "id"]), "short-keys")
    per_set = numbered.groupBy("id").agg(F.flatten(F.collect_set(F.array(F.col("number").cast("long"), "key"))).alias("keys"))
    members = written(bucket_members(per_set.mapInArrow(_tables(count), "key long, id long")), "table-members")
    member = Membership(docs.sparkSession, members.select("id").distinct())
    sets = docs.where("doc_id IS NOT NULL").mapInArrow(_sets(member.tester()), f"id long, items array<long>, {SKETCH}")
    sets = written(sets.join(members.select("id").distinct(), "id", "left_semi"), "shingle-sets")
    _, links = linked_components(members, sets, percent, lambda pairs: confirmed(pairs, sets, percent))
    labels = components(links.unionByName(copies))
    return (
        signed.select("doc_id", "n_shingles")
        .join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


@query("op8_minhash_near_dedup")
def near_dedup_query(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
