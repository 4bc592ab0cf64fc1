"""Exact quantiles without buffering a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in memory.
Here a sketch first brackets each wanted rank.  A second pass counts what lies
between the brackets and only the few values inside them one by one.  A bracket
that still holds too many rows is sketched again, so the part that is sorted stays
bounded however large the data is.  The sketch decides about cost, never about the
result: a rank that turns out to lie outside its bracket is searched again.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.expr import edges_passed, quoted
from flowspark.functions.sequence import CHUNK_ROWS, running_total, with_sequence
from flowspark.session import collect_bounded, local_table, materialize

SKETCH_SIZE = 4096
# Four times the rank error that a sketch of this size has with 99 % confidence.
SLACK = 0.003
BRACKET_ROWS = 2_000_000
GRID = [i / 400 for i in range(401)]

Intervals = list[tuple[float, float]]
Coder = Callable[[dict[object, Intervals]], DataFrame]


def _merge(intervals: Intervals) -> Intervals:
    """Sorted disjoint closed intervals."""
    merged: Intervals = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _points(intervals: Intervals) -> list[float]:
    """Edges whose number at or below a value is odd exactly inside an interval."""
    return [p for low, high in intervals for p in (low, math.nextafter(high, math.inf))]


def _ranks(rows: int, probabilities: Sequence[float]) -> dict[float, tuple[int, float]]:
    """0-based rank and the fraction of the step to the next one, per probability."""
    places = {}
    for q in probabilities:
        position = q * (rows - 1)
        places[q] = (math.floor(position), position - math.floor(position))
    return places


def _needed(rows: int, probabilities: Sequence[float]) -> list[int]:
    wanted = set()
    for rank, part in _ranks(rows, probabilities).values():
        wanted.add(rank)
        if part > 0:
            wanted.add(rank + 1)
    return sorted(wanted)


def _narrow(coded: DataFrame, needed: dict[object, list[int]]) -> tuple[dict[object, Intervals], int]:
    """Sketch the rows inside the brackets and tighten them; also the largest population left."""
    inside = F.col("_v")
    stats = coded.groupBy("_k", "_code").agg(
        F.count("*").alias("n"),
        F.min(inside).alias("lo"),
        F.max(inside).alias("hi"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(inside, SKETCH_SIZE), F.lit(GRID)).alias("grid"),
    )
    segments: dict[object, list] = {}
    for row in collect_bounded(stats, "Bracket counts"):
        segments.setdefault(row["_k"], []).append(row)
    tightened: dict[object, Intervals] = {}
    largest = 0
    for key, ranks in needed.items():
        rows = sorted(segments[key], key=lambda r: r["_code"])
        ends, total = [], 0
        for row in rows:
            total += row["n"]
            ends.append(total)
        found: Intervals = []
        for rank in ranks:
            i = bisect.bisect_right(ends, rank)
            row = rows[i]
            share = (rank - (ends[i] - row["n"])) / max(row["n"] - 1, 1)
            first = max(0, math.floor((share - SLACK) * 400))
            last = min(400, math.ceil((share + SLACK) * 400))
            low = row["lo"] if first == 0 else row["grid"][first]
            high = row["hi"] if last == 400 else row["grid"][last]
            found.append((low, high))
            if low < high:
                largest = max(largest, math.ceil(row["n"] * (last - first) / 400))
        tightened[key] = _merge(found)
    return tightened, largest


def _locate(coded: DataFrame, needed: dict[object, list[int]], key_type: str) -> dict[object, dict[int, float | None]]:
    """Values at the needed ranks; None where a bracket missed its rank."""
    exact = F.when(F.col("_code") % 2 == 1, F.col("_v"))
    cells = coded.groupBy("_k", "_code", exact.alias("_x")).agg(
        F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    order = Window.partitionBy("_k").orderBy("_code", "_x").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("upto", F.sum("n").over(order))
    spark = coded.sparkSession
    wanted = local_table(
        spark, [(k, r) for k, ranks in needed.items() for r in ranks], f"_k {key_type}, rank bigint"
    )
    hits = counted.join(wanted, "_k").where(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    value = (
        F.when(F.col("_x").isNotNull(), F.col("_x"))
        .when(F.col("rank") == F.col("upto") - F.col("n"), F.col("lo"))
        .when(F.col("rank") == F.col("upto") - 1, F.col("hi"))
    )
    located: dict[object, dict[int, float | None]] = {k: {} for k in needed}
    for row in collect_bounded(hits.select("_k", "rank", value.alias("v")), "Quantile ranks"):
        located[row["_k"]][row["rank"]] = row["v"]
    return located


def _solve(
    sizes: dict[object, int],
    brackets: dict[object, Intervals],
    probabilities: Sequence[float],
    code: Coder,
    key_type: str,
) -> dict[object, dict[float, float]]:
    values: dict[object, dict[int, float]] = {k: {} for k in sizes}
    open_ranks = {k: _needed(n, probabilities) for k, n in sizes.items()}
    population = max((math.ceil(2 * SLACK * n) for n in sizes.values()), default=0)
    while open_ranks:
        while population > BRACKET_ROWS:
            before = population
            brackets, population = _narrow(code(brackets), open_ranks)
            if population >= before:
                break
        missed = {}
        for k, found in _locate(code(brackets), open_ranks, key_type).items():
            values[k].update({r: v for r, v in found.items() if v is not None})
            rest = [r for r in open_ranks[k] if r not in values[k]]
            if rest:
                missed[k] = rest
        open_ranks = missed
        # A missed rank is bracketed again from the whole range.
        brackets = {k: [(-math.inf, math.inf)] for k in missed}
        population = max((sizes[k] for k in missed), default=0)
    answers: dict[object, dict[float, float]] = {}
    for k, n in sizes.items():
        answers[k] = {}
        for q, (rank, part) in _ranks(n, probabilities).items():
            first = values[k][rank]
            answers[k][q] = first + (values[k][rank + 1] - first) * part if part > 0 else first
    return answers


def _checked(probabilities: Sequence[float]) -> list[float]:
    listed = sorted({float(q) for q in probabilities})
    if not listed or any(not 0.0 <= q <= 1.0 for q in listed):
        raise ValueError("Quantile probabilities must lie in [0, 1].")
    return listed


def _first_ranks(listed: Sequence[float]) -> list[float]:
    return [r for q in listed for r in (max(0.0, q - SLACK), min(1.0, q + SLACK))]


def _first_brackets(points: Sequence[float]) -> Intervals:
    return _merge(list(zip(points[::2], points[1::2])))


def _sketched(value) -> object:
    return F.kll_sketch_agg_double(value, SKETCH_SIZE)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, dict[float, float]]:
    """{column: {probability: quantile}}, linearly interpolated; NULLs are ignored.

    A column without values is absent.  Values have to be finite.
    """
    listed = _checked(probabilities)
    names = [f"v{i}" for i in range(len(columns))]
    wide = df.select(*[quoted(c).cast("double").alias(n) for c, n in zip(columns, names)])
    ranks = F.lit(_first_ranks(listed))
    sizes: dict[object, int] = {}
    brackets: dict[object, Intervals] = {}
    for start in range(0, len(names), 25):
        part = names[start : start + 25]
        row = wide.agg(
            *[F.count(n).alias(f"{n}_n") for n in part],
            *[
                F.when(F.count(n) > 0, F.kll_sketch_get_quantile_double(_sketched(F.col(n)), ranks)).alias(f"{n}_q")
                for n in part
            ],
        ).first()
        for n in part:
            if row[f"{n}_n"]:
                sizes[n] = row[f"{n}_n"]
                brackets[n] = _first_brackets(row[f"{n}_q"])

    def code(current: dict[object, Intervals]) -> DataFrame:
        # Position relative to the brackets is literal arithmetic beside each column.
        cells = []
        for n, intervals in current.items():
            cells += [F.lit(n), F.col(n), edges_passed(F.col(n), _points(intervals))]
        stacked = wide.select(F.stack(F.lit(len(current)), *cells).alias("_k", "_v", "_code"))
        return stacked.where("_v IS NOT NULL")

    solved = _solve(sizes, brackets, listed, code, "string")
    return {c: solved[n] for c, n in zip(columns, names) if n in solved}


def group_quantiles(
    df: DataFrame, key: str, value: str, probabilities: Sequence[float]
) -> dict[object, dict[float, float]]:
    """{group: {probability: quantile}} for a column with a bounded number of groups."""
    listed = _checked(probabilities)
    rows = df.select(quoted(key).alias("_k"), quoted(value).cast("double").alias("_v")).where(
        "_v IS NOT NULL AND _k IS NOT NULL"
    )
    sketch = rows.groupBy("_k").agg(
        F.count("*").alias("n"),
        F.kll_sketch_get_quantile_double(_sketched(F.col("_v")), F.lit(_first_ranks(listed))).alias("q"),
    )
    found = collect_bounded(sketch, "Quantile groups")
    sizes = {r["_k"]: r["n"] for r in found}
    brackets = {r["_k"]: _first_brackets(r["q"]) for r in found}
    key_type = df.schema[key].dataType.simpleString()

    def code(current: dict[object, Intervals]) -> DataFrame:
        table = local_table(
            df.sparkSession,
            [(k, _points(intervals)) for k, intervals in current.items()],
            f"_k {key_type}, _points array<double>",
        )
        # A row of points for each group: without the hint, a low threshold would deal all rows by their group.
        joined = rows.join(F.broadcast(table), "_k")
        passed = F.size(F.filter("_points", lambda p: p <= F.col("_v")))
        return joined.select("_k", "_v", passed.alias("_code"))

    return _solve(sizes, brackets, listed, code, key_type)


def group_quantile_table(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row a group with ``q0``, ``q1``, ... for the probabilities in the order given; the groups may be any number.

    Distinct values are sorted by group and value as one sequence with running counts, so a group's ranks are places in
    it and a large group lies in many chunks.  Linearly interpolated; rows without a key or a value do not count.
    """
    _checked(probabilities)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[quoted(k).alias(n) for k, n in zip(keys, names)], quoted(value).cast("double").alias("_v")).na.drop("any")
    cells = rows.groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    counted = materialize(running_total(with_sequence(cells, [*names, "_v"]), "_c", "_upto", chunk_rows=chunk_rows), "ranked")
    sizes = counted.groupBy(*names).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_base"))
    joined = counted.join(sizes, names)
    found = []
    for i, q in enumerate(probabilities):
        place = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            at = F.col("_base") + rank
            here = (F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)
            found.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
        found.append(F.max(place - F.floor(place)).alias(f"_part{i}"))
    result = joined.groupBy(*names).agg(*found)
    between = [(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(f"q{i}") for i in range(len(probabilities))]
    return result.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *between)
