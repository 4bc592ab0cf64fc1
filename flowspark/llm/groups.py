"""Candidate buckets, confirmed links and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.base import U64, batch, mix, numbers_of, written

UNITED = 1 << 19  # links that a task unites at a time


def _stars(batches):
    """Sorted (key, id) rows -> the members of every bucket with two distinct ids or more.

    Only the last row seen is held, so a bucket of any size passes through.
    """
    key, last, rank = 0, 0, 0
    for b in batches:
        k, i = numbers_of(b.column(0)), numbers_of(b.column(1))
        if not len(k):
            continue
        if rank:
            k, i = np.concatenate(([key], k)), np.concatenate(([last], i))
        fresh = np.ones(len(k), np.bool_)
        fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        k, i = k[fresh], i[fresh]
        head = np.ones(len(k), np.bool_)
        head[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        place = np.arange(len(k)) - start[group] + 1
        if rank:
            place[group == 0] += rank - 1
        followed = np.append(~head[1:], False)
        out = (place > 1) | followed
        if rank > 1:
            out[0] = False  # it went out with the batch before
        key, last, rank = int(k[-1]), int(i[-1]), int(place[-1])
        yield batch(key=k[out], id=i[out])


def bucket_members(keys: DataFrame) -> DataFrame:
    """``key``, ``id`` (longs) -> those of buckets that hold two ids or more, without repeats."""
    return keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_stars, "key long, id long")


def ranked_members(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members with their sketches and their ``rank`` in the bucket: those with the most company over all buckets come first.

    The text that others were made from agrees with each of them more often than they do among themselves, so
    it comes first in its buckets and links them in one round.
    """
    company = members.groupBy("key").agg(F.count("*").alias("size"))
    weight = members.join(company, "key").groupBy("id").agg(F.sum("size").alias("weight"))
    order = Window.partitionBy("key").orderBy(F.desc("weight"), "id")
    known = members.join(weight, "id").join(sketches.select("id", *SKETCH_NAMES), "id")
    return known.withColumn("rank", F.row_number().over(order).cast("long")).drop("weight")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (id, smallest id that these links reach from it) of every id that is not the smallest itself."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    place, root = place.reshape(2, -1), np.arange(len(ids))
    while True:
        low, high = np.sort(root[place], axis=0)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _united(batches):
    """Links as the stars of what ``UNITED`` of them connect at a time: they connect the same ids."""
    held, rows = [], 0

    def stars():
        a, b = _forest(*(np.concatenate(side) for side in zip(*held)))
        return batch(a=a, b=b)

    for b in batches:
        held.append((numbers_of(b.column(0)), numbers_of(b.column(1))))
        rows += b.num_rows
        if rows >= UNITED:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """Union-find by alternating stars: (``a``, ``b``) -> (``id``, ``label``), label the smallest id reachable.

    Tasks unite the links they hold before and after every round, which leaves few rounds.  A round ties each id's
    neighbours to the smallest of them; it moves at most as many rows as there are links and combines minima before the
    shuffle.  Small tables are written as few files.  Ids that no link names are absent.
    """
    edges = written(links.select("a", "b").where("a != b").mapInArrow(_united, "a long, b long"), "links")
    while rows := _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(_in_few(large, rows), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a != b").distinct()
        edges = written(_in_few(small, rows).mapInArrow(_united, "a long, b long"), "small-star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("label"))
    ).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Number of the links, 0 if each id is tied to one label that is tied to none."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("label")), F.struct(F.col("b").alias("id"), F.col("b").alias("label"))))
    each = edges.select(ends.alias("e")).groupBy("e.id").agg(F.count("*").alias("n"), F.min("e.label").alias("lo"), F.max("e.label").alias("hi"))
    row = each.agg(F.sum("n").alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("open")).first()
    return row.n // 2 if row.open else 0


def _in_few(links: DataFrame, rows: int) -> DataFrame:
    """As many partitions as so many links are worth."""
    return links.coalesce(-(-rows // UNITED))


def sketch_columns(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Size of each set and its odd sketch: 512 bits, each the parity of the elements that hash to it.

    Sketches of two sets differ in no more bits than the sets differ in elements, so comparing sketches can rule
    a pair out and never rules out wrongly.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    words = np.zeros((len(sets), SKETCH_WORDS), np.int64)
    width = 64 * SKETCH_WORDS
    for at in range(0, len(sets), 256):
        own = sizes[at : at + 256]
        items = np.concatenate(sets[at : at + 256]).view(U64)
        spots = np.repeat(np.arange(len(own)) * width, own) + (mix(items) >> U64(64 - 9)).astype(np.int64)
        odd = (np.bincount(spots, minlength=len(own) * width) & 1).astype(np.uint8)
        words[at : at + 256] = np.packbits(odd.reshape(len(own), width), axis=1).view(np.int64)
    return {"n": sizes, **{f"s{w}": np.ascontiguousarray(words[:, w]) for w in range(SKETCH_WORDS)}}


SKETCH_WORDS = 8
SKETCH = ", ".join(["n long", *(f"s{w} long" for w in range(SKETCH_WORDS))])
SKETCH_NAMES = ["n", *(f"s{w}" for w in range(SKETCH_WORDS))]


def _may_be_similar(percent: int) -> Column:
    """Sizes and sketches allow 100 * intersection >= percent * union between a row and pivot p."""
    differing = sum((F.bit_count(F.col(f"s{w}").bitwiseXOR(F.col(f"p_s{w}"))) for w in range(1, SKETCH_WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("p_s0"))))
    sizes = 100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")
    return sizes & (differing * (100 + percent) <= (F.col("n") + F.col("p_n")) * (100 - percent))


def linked_components(members: DataFrame, sketches: DataFrame, percent: int, confirm: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Components of the confirmed links among bucket members; no link between them is lost.

    ``members``: ``key``, ``id``; ``sketches``: ``id`` and the sketch columns of its set.  ``confirm`` turns pairs (``a``, ``b``)
    into those with 100 * intersection >= percent * union.  In the first round the most central member of each bucket
    meets all others; later rounds take the next 15, 240, ... members, only in buckets that still hold several
    components, and only against members of other components.  A pair that its sketches rule out is dropped; any
    other is compared unless its members are connected already, which is all that components need.

    Returns (``id``, ``label``) and the confirmed links.
    """
    done, ahead, links, labels = 0, 1, None, None
    own = ["key", "id", "rank", *SKETCH_NAMES]
    rest = written(ranked_members(members, sketches).select(*own), "ranked-members").withColumn("label", F.col("id"))
    while True:
        pivots = rest.where((F.col("rank") > done) & (F.col("rank") <= ahead)).select(
            "key", F.col("id").alias("p"), F.col("rank").alias("p_rank"), F.col("label").alias("p_label"),
            *[F.col(c).alias(f"p_{c}") for c in SKETCH_NAMES],
        )
        both = rest.join(pivots, "key").where((F.col("rank") > F.col("p_rank")) & (F.col("label") != F.col("p_label")) & _may_be_similar(percent))
        pairs = both.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
        found = written(confirm(pairs.distinct()), "confirmed")
        links = found if links is None else links.unionByName(found)
        if labels is None:
            labels = written(components(found), "labels")
        elif not found.isEmpty():  # what is connected already goes on as a star
            labels = written(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(found)), "labels")
        done, ahead = ahead, ahead * 16
        known = rest.select(*own).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        bucket = Window.partitionBy("key")
        known = known.withColumns({"lo": F.min("label").over(bucket), "hi": F.max("label").over(bucket), "last": F.max("rank").over(bucket)})
        rest = written(known.where((F.col("lo") != F.col("hi")) & (F.col("last") > done + 1)).select(*own, "label"), "open-buckets")
        if rest.isEmpty():
            return labels, links
