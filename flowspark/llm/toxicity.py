"""Toxic passages by maximum-scoring segments.

Every word has a log-odds of toxic against other documents.  Counts are smoothed by a chain of Dirichlet priors:
a word's prior is the rate of its first eight letters, theirs that of the first seven, down to the base rate, so that
unseen forms of a toxic stem score too.  A linear-time scan finds all maximal-scoring segments of a text.  The best
segment of non-toxic texts follows an extreme-value (Gumbel) distribution in the length; the fitted distribution
gives each segment's p-value, and a logistic curve turns a text's strongest and summed evidence into its score.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.base import batch, prepare, query, slices, table, texts_of, written

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8  # letters of the prefixes that serve as priors
PRIOR = 6.0  # documents that a prior counts as
CAUTION = 2.5  # standard errors by which a rate is drawn towards the base rate
DRIFT = 0.2  # taken from each word's score, so that a background word's is negative
SIGNIFICANT = 0.01
LEAST_SCALE = 0.25  # of the Gumbel distribution, where most texts have no segment at all
THRESHOLD = 0.7
#: Bounds of the fitted classifier: labelled rows (by hash order) and counted forms (the most frequent ones).
SAMPLE_ROWS = 24_000
MAX_FORMS = 300_000
CHUNK = 4_000_000
REMEMBERED = 300_000


def forms(word: str) -> list[str]:
    """The word itself (marked by a final space) and its prefixes, longest first."""
    return [word + " ", *(word[:n] for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1))]


def _code(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form.encode())


@dataclass(frozen=True)
class ToxicityModel:
    codes: np.ndarray  # hashes of the forms
    scores: np.ndarray  # of each form
    gumbel: tuple[float, float, float]  # location, scale, and what a unit of log length adds
    curve: tuple[float, ...]  # intercept and slopes of the logistic curve


class WordScores(dict):
    """Score of each word as written, remembered."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.scores = dict(zip(model.codes.tolist(), model.scores.tolist()))

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = (self.scores.get(_code(f)) for f in forms(word.lower()))
        value = next((s for s in found if s is not None), 0.0) - DRIFT
        self[word] = value
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past last, score), by one scan with a stack of candidates.

    A candidate holds the sums before it and up to its end.  A new one joins the nearest earlier candidate whose
    start sum is smaller, unless that one already reaches as high; then it stays by itself.
    """
    sums = np.cumsum(scores)
    stack: list[list] = []  # first, last, sum before, sum at end, place of nearest candidate with a smaller start
    for k in np.flatnonzero(scores > 0).tolist():
        new = [k, k + 1, float(sums[k] - scores[k]), float(sums[k]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, z, end - before) for a, z, before, end, _ in stack]


def _tail(model_gumbel: tuple[float, float, float], best: np.ndarray, words: np.ndarray) -> np.ndarray:
    """-log of the p-value of segment scores in texts of so many words."""
    place, scale, slope = model_gumbel
    x = (best - place - slope * np.log(np.maximum(words, 1))) / scale
    tail = -np.expm1(-np.exp(-np.clip(x, -5, 700)))
    return np.where(x > 30, x, -np.log(np.maximum(tail, 1e-300)))


def _evidence(gumbel: tuple[float, float, float], segments: list[float], words: int) -> tuple[float, float, int]:
    """-log p of the best segment, the log of the sum over significant ones, and their number."""
    if not segments:
        return 0.0, 0.0, 0
    tails = _tail(gumbel, np.array(segments), np.array(words))
    strong = tails[tails > -math.log(SIGNIFICANT)]
    return float(min(tails.max(), 200.0)), float(np.log1p(strong.sum())), len(strong)


def _features(gumbel, segments: list[float], words: int, distinct: float) -> np.ndarray:
    """What the logistic curve weighs; ``distinct``: sum of the positive scores, each word counted once."""
    best, total, _ = _evidence(gumbel, segments, words)
    return np.array([1.0, math.log1p(best), total, math.log1p(distinct), math.log1p(100.0 * distinct / (words + 20.0))])


def _distinct(known: WordScores, words: list[str]) -> float:
    return float(sum(v for v in (known[w] for w in {w.lower() for w in words}) if v > 0))


def score_text(model: ToxicityModel, known: WordScores, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a whole text and its significant passages in characters."""
    words = WORD.findall(text)
    values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
    segments = maximal_segments(values)
    distinct = _distinct(known, words) if segments else 0.0
    x = _features(model.gumbel, [s for _, _, s in segments], len(words), distinct)
    score = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(x @ np.array(model.curve))))))
    spans = []
    if segments:
        tails = _tail(model.gumbel, np.array([s for _, _, s in segments]), np.array(len(words)))
        if tails.max() > -math.log(SIGNIFICANT):
            at = [m.span() for m in WORD.finditer(text)]
            spans = [(at[a][0], at[z - 1][1], s) for (a, z, s), t in zip(segments, tails) if t > -math.log(SIGNIFICANT)]
    return score, spans


def _count_forms(batches):
    """In how many toxic and other documents each form occurs."""
    held: dict[str, list[int]] = {}
    for b in slices(batches, "text", CHUNK):
        for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
            for f in {f for w in set(WORD.findall(text)) for f in forms(w.lower())}:
                held.setdefault(f, [0, 0])[toxic] += 1
        if len(held) > 1_000_000:
            yield _forms(held)
            held = {}
    yield _forms(held)


def _forms(held: dict[str, list[int]]) -> pa.RecordBatch:
    return batch(form=pa.array(list(held), pa.string()), clean=pa.array([v[0] for v in held.values()], pa.int64()), toxic=pa.array([v[1] for v in held.values()], pa.int64()))


def form_scores(counts: dict[str, tuple[int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Log-odds of each form against the base rate, at the end of its interval that is nearer to that rate."""
    base = (toxic + 1) / (clean + toxic + 2)
    rates: dict[str, float] = {}
    scores = {}
    for form in sorted(counts, key=lambda f: (len(f.rstrip(" ")), f.endswith(" "))):
        word = form.rstrip(" ")
        above = [word, *(word[:n] for n in range(len(word) - 1, SHORTEST - 1, -1))] if form.endswith(" ") else [
            word[:n] for n in range(len(word) - 1, SHORTEST - 1, -1)]
        prior = next((rates[f] for f in above if f in rates), base)
        c, t = counts[form]
        rates[form] = rate = (t + PRIOR * prior) / (c + t + PRIOR)
        low, high = _rate_bounds(rate, c + t + PRIOR)
        safe = low if low > base else high if high < base else base
        scores[form] = math.log(safe / (1 - safe)) - math.log(base / (1 - base))
    return scores


def _rate_bounds(rate: float, n: float) -> tuple[float, float]:
    """Wilson's interval of a rate seen in n cases."""
    z = CAUTION
    middle, half = rate + z * z / (2 * n), z * math.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def _segment_rows(shared):
    def run(batches):
        known = WordScores(shared.value)
        for b in slices(batches, "text", CHUNK):
            words, found, distinct = [], [], []
            for text in texts_of(b.column(0)):
                own = WORD.findall(text)
                values = np.fromiter(map(known.__getitem__, own), np.float64, len(own))
                words.append(len(own))
                found.append([s for _, _, s in maximal_segments(values)])
                distinct.append(_distinct(known, own))
            yield batch(words=pa.array(words, pa.int64()), segments=pa.array(found, pa.list_(pa.float64())), toxic=b.column(1),
                        distinct=pa.array(distinct, pa.float64()))

    return run


def _feature_rows(gumbel: tuple[float, float, float]):
    """What the curve is fitted on, from all segments of each text, as in scoring."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (0, 1, 3)))
            x = [_features(gumbel, segments, words, distinct).tolist() for words, segments, distinct in rows]
            yield batch(x=pa.array(x, pa.list_(pa.float64())), toxic=b.column(2))

    return run


def fit_gumbel(best: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Gumbel location and scale of the best scores from two quantiles, after their slope in the log length."""
    if len(best) < 10 or np.ptp(best) == 0:
        return 0.0, 1.0, 0.0
    length = np.log(np.maximum(words, 1))
    slope = max(0.0, float(np.polyfit(length, best, 1)[0])) if np.ptp(length) > 0 else 0.0
    rest = best - slope * length
    middle, high = np.quantile(rest, (0.5, 0.95))
    low_at, high_at = -math.log(math.log(2)), -math.log(-math.log(0.95))
    scale = max(LEAST_SCALE, float(high - middle) / (high_at - low_at))
    return float(middle) - low_at * scale, scale, slope


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled documents, by hash order; three quarters give counts, the rest calibrates.

    Rows with crc32(id) mod 3 = 1 are never learned from.  Labels are 0 or 1; others and nulls are left out.  Of the
    counted rows' forms those in three toxic texts or twenty texts at least have a score, at most the ``MAX_FORMS`` most frequent.
    """
    spark = documents.sparkSession
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.where("pmod(crc32(cast(doc_id AS string)), 3) != 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = own.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rows).collect()
    if not drawn:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), (0.0, 1.0, 0.0), (-5.0, 0.0, 0.0, 0.0, 0.0))
    part = spark.createDataFrame([(r.doc_id, r.toxic, int(k % 4 == 3)) for k, r in enumerate(drawn)], "doc_id long, toxic int, calibrates int")
    # At most `rows` rows of three numbers.
    learned = documents.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("text", "toxic", "calibrates")
    counting = learned.where("calibrates = 0").select("text", "toxic")
    counted = counting.mapInArrow(_count_forms, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.where("toxic >= 3 OR clean + toxic >= 20").orderBy(F.desc(F.col("clean") + F.col("toxic")), "form").limit(MAX_FORMS).toArrow()
    totals = {r.toxic: r["count"] for r in counting.groupBy("toxic").count().collect()}
    names, clean, toxic = (counted.column(k).to_pylist() for k in range(3))
    found = form_scores(dict(zip(names, zip(clean, toxic))), totals.get(0, 0), totals.get(1, 0))
    words = np.array([_code(f) for f in found], np.uint64), np.array(list(found.values()))
    del counted, names, clean, toxic, found
    shared = spark.sparkContext.broadcast(ToxicityModel(*words, (0.0, 1.0, 0.0), ()))
    seen = learned.where("calibrates = 1").select("text", "toxic").mapInArrow(_segment_rows(shared), "words long, segments array<double>, toxic int, distinct double")
    # Segments stay in a written table; the driver gets a few numbers a text.
    seen = written(seen, "calibration")
    shared.destroy()
    best = seen.select("words", "toxic", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).collect()
    clean = sorted((r.words, r.best) for r in best if r.toxic == 0)
    gumbel = fit_gumbel(np.array([b for _, b in clean]), np.array([w for w, _ in clean]))
    if len({r.toxic for r in best}) < 2:
        return ToxicityModel(*words, gumbel, (-5.0, 1.0, 0.0, 0.0, 0.0))
    weighed = sorted(seen.mapInArrow(_feature_rows(gumbel), "x array<double>, toxic int").collect())
    curve = fit_curve(np.array([r.x for r in weighed]), np.array([float(r.toxic) for r in weighed]))
    return ToxicityModel(*words, gumbel, tuple(float(c) for c in curve))


def _scorer(shared):
    model = shared.value
    return model, WordScores(model)


def _score(shared):
    def run(batches):
        model, known = _scorer(shared)
        for b in slices(batches, "text", CHUNK):
            found = [score_text(model, known, t) for t in texts_of(b.column(1))]
            held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in b.column(0).to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            spans = [[{"start": a, "end": z, "score": v} for a, z, v in s] for _, s in found]
            yield batch(doc_id=b.column(0), held_out=pa.array(held, pa.bool_()), score=pa.array([s for s, _ in found], pa.float64()),
                        predicted=pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()), passages=pa.array(spans, span))

    return run


def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every whole text: ``doc_id``, ``held_out``, ``score``, ``predicted`` and ``passages``.

    ``passages`` are the significant segments as character ranges (end exclusive) with their scores.  Null and empty
    texts score as texts without a segment.  Rows keep their (null or repeated) ids; equal texts score alike.
    ``held_out`` is null where the id is.
    """
    docs = prepare(documents, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:bigint,end:bigint,score:double>>"
    return docs.mapInArrow(_score(shared), kind)


def _keep(shared):
    def run(batches):
        model, known = _scorer(shared)
        for b in slices(batches, "text", CHUNK):
            at = b.schema.get_field_index("text")
            keep = [score_text(model, known, t)[0] < THRESHOLD for t in texts_of(b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; nothing is shuffled."""
    prepare(documents, "doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_keep(shared), documents.schema)


@query("op6_toxicity")
def toxicity_query(spark, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return score_documents(documents, fit(prepare(documents, "doc_id", "text"), table(spark, folder, "labels")))
