"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the character 2-, 3- and 4-grams of lower-cased words with their boundaries.  Embeddings and softmax are
trained by stochastic gradient descent in NumPy on a bounded sample.  As the prediction is linear in the average,
the embeddings are multiplied by the softmax weights once, and a task only adds up one number a language and
subword.  A temperature and a rejection threshold are fitted on a part of the sample that training did not see.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.base import U64, batch, mix, prepare, query, slices, table, texts_of

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
WIDTH = 16
#: Bounds of the training sample: rows and characters that reach the driver.  Both are shared out among the languages,
#: whose rows are drawn by hash of the text.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 12_000_000
EPOCHS = 6
RATE = 0.5
ACCEPTED = 0.995  # share of right answers on unseen rows that the rejection threshold keeps
CHUNK = 2_000_000


def letters_only(text: str) -> str:
    """Lower-cased text in which each stretch of other characters is one space, with one at both ends."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of a text; a space stands for a word's boundary and lies only at a subword's ends."""
    codes = np.frombuffer(letters_only(text).encode("utf-32-le"), np.uint32).astype(U64)
    space = codes == 32
    out = []
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + codes[k : k + count]
        inner = np.zeros(count, np.bool_)
        for k in range(1, n - 1):
            inner |= space[k : k + count]
        out.append(mix(h[~inner]) >> U64(48))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embedding times softmax weight
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, parts: np.ndarray) -> np.ndarray:
        return self.weights[parts].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is below the rejection threshold."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(subwords(text))[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel:
    """SGD over documents in random order; every fifth row of a language is kept back for temperature and threshold."""
    rows = [(subwords(t), g) for t, g in zip(texts, languages) if any(map(str.isalpha, t))]
    names = sorted({g for _, g in rows})
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    soft, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    target = np.array([names.index(g) for _, g in rows])
    order = rng.permutation(len(rows))
    seen = np.zeros(len(names), np.int64)
    back = np.zeros(len(rows), np.bool_)
    for k in order:
        seen[target[k]] += 1
        back[k] = seen[target[k]] % 5 == 0
    kept_back, used = order[back[order]], np.flatnonzero(~back)
    if not len(kept_back):
        kept_back = order
    counted = [np.unique(p, return_counts=True) for p, _ in rows]
    for epoch in range(EPOCHS):
        for step, k in enumerate(rng.permutation(used)):
            rate = RATE * (1 - (epoch * len(used) + step) / (EPOCHS * len(used)))
            parts, share = counted[k][0], counted[k][1] / counted[k][1].sum()
            mean = share @ embed[parts]
            error = _softmax((mean @ soft + bias)[None])[0]
            error[target[k]] -= 1
            back = soft @ error
            soft -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embed[parts] -= rate * len(parts) ** 0.5 * share[:, None] * back
    weights = (embed @ soft).astype(np.float64)
    model = LanguageModel(names, weights, bias, 1.0, 0.0)
    logits = np.stack([model.logits(rows[k][0]) for k in kept_back])
    right = target[kept_back]
    scales = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / s)[np.arange(len(right)), right] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = _softmax(logits / scale)
    sure = p.max(axis=1)[p.argmax(axis=1) == right]
    threshold = float(np.quantile(sure, 1 - ACCEPTED)) if len(sure) else 0.0
    return LanguageModel(names, weights, bias, scale, threshold)


def _predict(shared, held_out):
    def run(batches):
        model = shared.value
        for b in slices(batches, "text", CHUNK):
            ids = b.column(0).to_pylist()
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield batch(doc_id=b.column(0), held_out=pa.array([held_out(i) for i in ids], pa.bool_()), lang_pred=pa.array([f[0] for f in found], pa.string()),
                        score=pa.array([f[1] for f in found], pa.float64()), rejected=pa.array([f[2] for f in found], pa.bool_()))

    return run


def is_held_out(doc_id: int | None) -> bool:
    """Rows that training never sees; a row without an id is one of them."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows that each language gives: alike, and what a small one cannot fill goes to the others; at least one."""
    out, left = {}, rows
    for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g))):
        out[g] = min(counts[g], max(1, left // (len(counts) - k)))
        left = max(0, left - out[g])
    return out


def fit(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Train on at most ``rows`` labelled documents and ``chars`` characters, drawn by hash within each language.

    Every language has one row at least, however many there are.  Each may give an equal part of the characters: a
    text that does not fit is passed over, and if none fits, the beginning of the first one is learned.
    """
    learned = documents.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), 5) != 0")
    learned = learned.select("lang", "text", F.length("text").alias("size"), F.xxhash64("text", "doc_id").alias("place"))
    counts = {r.lang: max(1, r.n) for r in learned.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    if not counts:
        return train([], [])
    wanted, most = shares(counts, rows), max(1, chars // len(counts))
    # The first places of each language, more than are wanted, as some texts are passed over.
    part = documents.sparkSession.createDataFrame([(g, min(1.0, (4 * wanted[g] + 64) / counts[g])) for g in counts], "lang string, part double")
    first = F.col("place") / F.lit(2.0**64) + 0.5 <= F.col("part")
    drawn = learned.select("lang", "size", "place").join(F.broadcast(part), "lang").where(first).select("lang", "size", "place").distinct().collect()
    places: dict[str, set[int]] = {g: set() for g in counts}
    room = dict.fromkeys(counts, most)
    drawn.sort(key=lambda r: (r.place, r.lang))
    for r in drawn:
        if len(places[r.lang]) < wanted[r.lang] and r.size <= room[r.lang]:
            places[r.lang].add(r.place)
            room[r.lang] -= r.size
    for r in drawn:
        if not places[r.lang]:
            places[r.lang].add(r.place)
    keys = documents.sparkSession.createDataFrame([(g, k) for g, own in places.items() for k in own], "lang string, place long")
    found = learned.join(F.broadcast(keys), ["lang", "place"]).select("place", F.substring("text", 1, most).alias("text"), "lang").distinct().collect()
    found.sort(key=lambda r: (r.place, r.text, r.lang))
    return train([r.text for r in found], [r.lang for r in found])


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Predict every whole text: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learned.
    ``rejected`` marks scores below the calibrated threshold; their prediction is given all the same.
    Equal texts get equal answers; ids only pass through.
    """
    docs = prepare(documents, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared, is_held_out), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


@query("op7_language_id")
def language_query(spark, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return identify(documents, fit(prepare(documents, "doc_id", "text", "lang")))
