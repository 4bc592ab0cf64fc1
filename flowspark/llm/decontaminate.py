"""Benchmark decontamination by templates.

Texts become words; in the typed reading numbers, names and units turn into placeholders, in the plain reading words
stand as they are, in lower case.  Where capitals do not tell names (at the start of a sentence, in texts without or
full of them), a third reading types every word that the benchmark does not use as a lower-case word.  Windows of eight words are hash-joined with those of the benchmark.  Windows on
one diagonal that follow one another form a passage, within a reading and over all; its placeholders must map
one-to-one from the benchmark's values to the document's, which finds re-parameterised questions and lets chance
agreement go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.base import GOLDEN, U64, batch, mix, numbers_of, prepare, query, slices, table, texts_of, written

WINDOW = 8
LITERALS = 4  # words of a window that must not be placeholders
PASSAGE = 13  # words that a passage must cover, or the whole item if it is shorter
HASHES_EACH = 4_000_000  # benchmark windows that one pass over the documents looks for (32 MB)
CHUNK = 4_000_000
REMEMBERED = 300_000
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
WORD, NUMBER, STOP = range(3)
PLAIN, TYPED, DOUBTFUL = range(3)
UNITED = 9  # stands for all readings together
#: Words that are units after a number.
UNITS = frozenset(
    """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
    mg g kg t gram grams kilogram kilograms ounce ounces oz lb lbs pound pounds ton tons liter liters litre litres l ml
    gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph joule joules watt watts volt volts
    newton newtons byte bytes kb mb gb""".split()
)
PLACEHOLDERS = {"number": 1, "name": 2, "unit": 3}


class Vocabulary:
    """Code, kind, capital, unit mark and doubt of tokens, remembered up to a bound.

    Doubtful is a word that is not ``ordinary`` (sorted hashes of lower-case words): it may be a name.
    """

    def __init__(self, ordinary: np.ndarray = np.zeros(0, U64)):
        self.ordinary = ordinary
        self.known: dict[str, int] = {}
        self.marks = np.zeros(1024, [("code", U64), ("kind", np.int8), ("capital", np.bool_), ("unit", np.bool_), ("doubt", np.bool_)])

    def marks_of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = set(tokens).difference(known)
        need = len(known) + len(new)
        if need > len(self.marks):
            self.marks = np.concatenate((self.marks, np.zeros(2 * need - len(self.marks), self.marks.dtype)))
        start = len(known)
        for t in new:
            low = t.lower()
            kind = STOP if t in ".!?\n" else NUMBER if t[0].isdigit() else WORD
            self.marks[len(known)] = (xxhash.xxh3_64_intdigest(low.encode()), kind, t[0].isupper(), low in UNITS, kind == WORD)
            known[t] = len(known)
        if new:
            fresh = self.marks[start:need]
            fresh["doubt"] &= ~among(fresh["code"], self.ordinary)
        return self.marks[np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))]


def among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes occur in a sorted array."""
    at = np.searchsorted(wanted, hashes)
    return np.append(wanted, U64(0))[at] == np.where(at < len(wanted), hashes, U64(1))


@dataclass
class Words:
    """The words of several texts, one after another."""

    tokens: list[str]
    at: np.ndarray  # place of each word among the tokens
    codes: np.ndarray  # [reading, word]
    holder: np.ndarray  # [reading, word] placeholder, 0 for none
    text: np.ndarray  # which text a word belongs to
    starts: np.ndarray  # first word of each text, and the number of words


def read_words(texts: list[str], vocabulary: Vocabulary) -> Words:
    """All readings of the texts' words."""
    found = [TOKEN.findall(t) for t in texts]
    tokens = [t for f in found for t in f]
    sizes = np.array([len(f) for f in found], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    marks = vocabulary.marks_of(tokens)
    kind, capital = marks["kind"], marks["capital"]
    first = np.ones(len(tokens), np.bool_)
    first[1:] = text[1:] != text[:-1]
    opens = first.copy()
    opens[1:] |= kind[:-1] == STOP
    after_number = np.zeros(len(tokens), np.bool_)
    after_number[1:] = (kind[:-1] == NUMBER) & ~first[1:]
    words = kind == WORD
    # Where most words have capitals, they do not mark names.
    named = 2 * np.bincount(text[words & capital], minlength=len(texts)) <= np.bincount(text[words], minlength=len(texts))
    holder = np.zeros((3, len(tokens)), np.int8)
    holder[TYPED, words & capital & ~opens & named[text]] = PLACEHOLDERS["name"]
    holder[DOUBTFUL, marks["doubt"]] = PLACEHOLDERS["name"]
    holder[TYPED:, words & marks["unit"] & after_number] = PLACEHOLDERS["unit"]
    holder[TYPED:, kind == NUMBER] = PLACEHOLDERS["number"]
    codes = np.where(holder > 0, holder.astype(U64), marks["code"])
    keep = np.flatnonzero(kind != STOP)
    starts = np.concatenate(([0], np.cumsum(np.bincount(text[keep], minlength=len(texts)))))
    return Words(tokens, keep, codes[:, keep], holder[:, keep], text[keep], starts)


def window_hashes(words: Words, reading: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words, and whether it may be used: it lies in one text, and a typed one needs
    literal words and a placeholder."""
    codes = words.codes[reading]
    count = len(codes) - size + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.bool_)
    h = np.full(count, size * 3 + reading, U64)
    for k in range(size):
        h = h * GOLDEN ^ codes[k : k + count]
        h ^= h >> U64(29)
    usable = words.text[:count] == words.text[size - 1 :]
    if reading != PLAIN:
        held = np.concatenate(([0], np.cumsum(words.holder[reading] > 0)))
        slots = held[size:] - held[:-size]
        usable &= (slots > 0) & (size - slots >= min(LITERALS, size))
    return mix(h), usable


HIT = "uid long, doc_id long, reading int, hash long, place long, slots array<string>, size int"


def _hits(wanted, sizes: list[int], ordinary):
    """Windows whose hash is wanted (sorted array, or None for all), with the values in their placeholders."""

    def hits(batches):
        vocabulary = Vocabulary(ordinary.value)
        hashes = None if wanted is None else wanted.value
        if hashes is not None:
            present = np.zeros(1 << 22, np.bool_)
            present[(hashes >> U64(42)).astype(np.int64)] = True
        for b in slices(batches, "text", CHUNK):
            doc_ids, uids = b.column(0).to_pylist(), b.column(1).to_pylist()
            words = read_words(texts_of(b.column(2)), vocabulary)
            out = [[] for _ in range(7)]
            for size in sizes:
                for reading in (PLAIN, TYPED, DOUBTFUL):
                    h, usable = window_hashes(words, reading, size)
                    at = np.flatnonzero(usable)
                    if hashes is not None:
                        at = at[present[(h[at] >> U64(42)).astype(np.int64)]]
                        at = at[np.isin(h[at], hashes)]
                    for p in at.tolist():
                        text = int(words.text[p])
                        slots = [words.tokens[words.at[p + k]].lower() if words.holder[reading, p + k] else None for k in range(size)]
                        for column, value in zip(out, (uids[text], doc_ids[text], reading, int(h[p].view(np.int64)), p - int(words.starts[text]), slots, size)):
                            column.append(value)
            yield batch(uid=pa.array(out[0], pa.int64()), doc_id=pa.array(out[1], pa.int64()), reading=pa.array(out[2], pa.int32()), hash=pa.array(out[3], pa.int64()),
                        place=pa.array(out[4], pa.int64()), slots=pa.array(out[5], pa.list_(pa.string())), size=pa.array(out[6], pa.int32()))

    return hits


def _word_count(batches):
    vocabulary = Vocabulary()
    for b in batches:
        words = read_words(texts_of(b.column(1)), vocabulary)
        yield batch(item_id=b.column(0), words=pa.array(np.diff(words.starts), pa.int64()))


def _cases(batches):
    """How many texts hold a word in lower case, and with a capital inside a sentence; of texts with both cases."""
    for b in slices(batches, "text", CHUNK):
        held: dict[str, list[int]] = {}
        for text in texts_of(b.column(0)):
            tokens = TOKEN.findall(text)
            words = [t for t in tokens if t not in ".!?\n" and not t[0].isdigit()]
            if not 0 < 2 * sum(w[0].isupper() for w in words) <= len(words):
                continue
            inside = {b for a, b in zip(tokens, tokens[1:]) if a not in ".!?\n"}
            for w in {t for t in words if not t[0].isupper()} | {t for t in inside if t[0].isupper()}:
                held.setdefault(w.lower(), [0, 0])[w[0].isupper()] += 1
        codes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in held], U64)
        yield batch(code=codes.view(np.int64), lower=pa.array([v[0] for v in held.values()], pa.int64()), upper=pa.array([v[1] for v in held.values()], pa.int64()))


def ordinary_words(items: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that benchmark items write in lower case more often than with a capital inside a sentence.

    Only these can be literal in a window of the benchmark, so no word of a document needs to be counted.  They take
    eight bytes a distinct word of the benchmark on the driver.
    """
    seen = items.select("text").mapInArrow(_cases, "code long, lower long, upper long").groupBy("code").agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper"))
    return np.sort(numbers_of(seen.where("lower > upper").select("code").toArrow().column(0)).view(U64))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of benchmark items in documents: one row for each document and item that agree.

    ``documents``: ``doc_id``, ``text``; ``benchmark``: ``item_id``, ``text``; other columns are ignored.  Rows:
    ``doc_id``, ``uid`` (hash of the text), ``item_id``, ``words`` (of the longest passage), ``item_words``, ``place`` (its first
    word in the document) and ``reworded`` (the plain reading alone does not agree).

    An item counts as found where a consistent passage covers 13 words, or all of it if it is shorter; items below
    eight words must occur whole.  Null and empty texts agree with nothing.  Null ids pass through; rows that repeat
    an id are told apart by their texts, items that repeat an id by nothing: they count as one.
    """
    uid = F.xxhash64("text").alias("uid")
    docs = prepare(documents, "doc_id", "text").select("doc_id", uid, "text")
    items = prepare(benchmark, "item_id", "text").where("item_id IS NOT NULL")
    context = docs.sparkSession.sparkContext
    ordinary = context.broadcast(ordinary_words(items))
    sent = [ordinary]
    lengths = written(items.mapInArrow(_word_count, "item_id long, words long").where("words > 0"), "item-words")
    short = sorted(r.words for r in lengths.where(F.col("words") < WINDOW).select("words").distinct().collect())
    sizes = [*short, WINDOW]
    asked = items.select(F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("uid"), "text").mapInArrow(_hits(None, sizes, ordinary), HIT)
    item_words = lengths.groupBy("item_id").agg(F.max("words").alias("item_words"))
    asked = asked.select(F.col("doc_id").alias("item_id"), "reading", "hash", "size", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    # A window shorter than eight words counts only as a whole item.
    asked = written(asked.join(item_words, "item_id").where((F.col("size") == WINDOW) | (F.col("size") == F.col("item_words"))), "item-windows")
    distinct = asked.select("hash").distinct()
    passes = max(1, -(-distinct.count() // HASHES_EACH))
    hits = None
    for k in range(passes):
        rows = numbers_of(distinct.where(F.pmod("hash", F.lit(passes)) == k).toArrow().column(0))
        sent.append(context.broadcast(np.sort(rows.view(U64))))
        found = docs.mapInArrow(_hits(sent[-1], sizes, ordinary), HIT)
        hits = found if hits is None else hits.unionByName(found)
    joined = hits.join(asked, ["reading", "hash", "size"]).withColumn("diagonal", F.col("place") - F.col("item_place"))
    own = ["doc_id", "uid", "item_id", "reading", "size", "diagonal"]
    joined = written(joined.dropDuplicates([*own, "item_place"]), "window-hits")
    for shared in sent:  # no later step looks words up
        shared.destroy()
    # A window without a placeholder agrees in the plain reading alone, so passages also form over all readings.
    joined = joined.withColumn("reading", F.explode(F.array("reading", F.lit(UNITED))))
    order = Window.partitionBy(*own).orderBy("item_place")
    passages = joined.withColumn("island", F.col("item_place") - F.dense_rank().over(order))
    spans = passages.groupBy(*own, "island", "item_words").agg(
        (F.max("item_place") - F.min("item_place") + 1).alias("windows"), F.min("place").alias("place"), F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))).alias("pairs")
    )
    pairs = F.filter("pairs", lambda p: p["slots"].isNotNull() & p["item_slots"].isNotNull())
    one = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    spans = spans.withColumn("pairs", F.array_distinct(pairs)).where((one("slots") == F.size("pairs")) & (one("item_slots") == F.size("pairs")))
    spans = spans.withColumn("words", F.col("windows") + F.col("size") - 1)
    spans = spans.where(F.col("words") >= F.least(F.lit(PASSAGE), F.col("item_words")))
    best = F.max(F.struct("words", F.negative("place").alias("back")))
    result = spans.groupBy("doc_id", "uid", "item_id", "item_words").agg(best.alias("best"), (F.min("reading") > PLAIN).alias("reworded"))
    return result.select("doc_id", "uid", "item_id", F.col("best.words").alias("words"), "item_words", (-F.col("best.back")).alias("place"), "reworded")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a passage of the benchmark, with all their columns."""
    found = contaminated(documents, benchmark).select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid")).distinct()
    same = documents["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__uid"))
    return documents.join(found, same, "left_anti")


@query("op5_decontamination")
def decontamination_query(spark, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("uid")
