"""Stratified splits, folds and resampling by cut points in a seeded hash order.

Rows of a class are ordered by a seeded hash of their id.  A part of the split is a
range of ranks in that order, and a range of ranks is a range of hashes.  So a split
is fitted by finding a handful of hash values, and applied as a comparison on each
row: no shuffle of the data, whatever its size and however uneven the classes are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.expr import quoted
from flowspark.functions.hashing import hash_number, row_hash
from flowspark.session import collect_bounded, local_table

PREFIX_DIGITS = 3
RANKED_ROWS = 1_000_000
RANK_DIGITS = 4


def class_counts(df: DataFrame, label: str) -> dict:
    rows = collect_bounded(df.groupBy(quoted(label).alias("c")).agg(F.count("*").alias("n")), "Class counts")
    if any(r["c"] is None for r in rows):
        raise ValueError("Stratification needs a label on every row.")
    return {r["c"]: r["n"] for r in sorted(rows, key=lambda r: str(r["c"]))}


def allocate(counts: Mapping, total: int) -> dict:
    """Share ``total`` rows among classes in proportion, largest remainder first."""
    everything = sum(counts.values())
    exact = {c: n * total / everything for c, n in counts.items()}
    share = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - share[c]), str(c)))
    for c in by_remainder[: total - sum(share.values())]:
        share[c] += 1
    return share


class HashOrder:
    """Rows of each class in the order of a seeded hash of their id.

    One scan counts rows per class and hash prefix.  The hash at a rank is found by
    descending into the prefix that holds the rank: prefixes with many rows are
    counted again with more digits, and only the rows of a small prefix are ranked.
    """

    def __init__(self, df: DataFrame, label: str, row_id: str, seed: int):
        self.spark = df.sparkSession
        self.kind = df.schema[label].dataType.simpleString()
        self.hashed = df.select(quoted(label).alias("_c"), row_hash(quoted(row_id), seed).alias("_h"))
        self.prefixes = self._count(self.hashed, PREFIX_DIGITS)
        if None in self.prefixes:
            raise ValueError("Stratification needs a label on every row.")
        self.counts = {
            c: sum(n for _, n in found) for c, found in sorted(self.prefixes.items(), key=lambda item: str(item[0]))
        }

    def _count(self, rows: DataFrame, digits: int) -> dict[object, list[tuple[str, int]]]:
        counted = rows.groupBy("_c", F.substring("_h", 1, digits).alias("_p")).agg(F.count("*").alias("n"))
        found: dict[object, list[tuple[str, int]]] = {}
        for row in collect_bounded(counted, "Hash prefixes", bound=4_000_000):
            found.setdefault(row["_c"], []).append((row["_p"], row["n"]))
        return {c: sorted(listed) for c, listed in found.items()}

    def _within(self, prefixes: set[tuple[object, str]], digits: int) -> DataFrame:
        table = local_table(self.spark, sorted(prefixes, key=str), f"_c {self.kind}, _p string")
        return self.hashed.withColumn("_p", F.substring("_h", 1, digits)).join(table, ["_c", "_p"])

    def cuts(self, ranks: Mapping[object, Sequence[int]]) -> dict[object, list[str]]:
        """Hash of the row at each wanted 1-based rank; rank 0 gives the empty string."""
        # (class, position in the list) -> (prefix, rank inside the prefix, rows of the prefix)
        open_cuts: dict[tuple[object, int], tuple[str, int, int]] = {}

        def descend(key, listed: list[tuple[str, int]], rank: int) -> None:
            for prefix, n in listed:
                if rank <= n:
                    open_cuts[key] = (prefix, rank, n)
                    return
                rank -= n

        for c, wanted in ranks.items():
            for i, rank in enumerate(wanted):
                if rank > 0:
                    descend((c, i), self.prefixes[c], int(rank))
        result = {c: [""] * len(wanted) for c, wanted in ranks.items()}
        if not open_cuts:
            return result
        digits = PREFIX_DIGITS
        while max(n for _, _, n in open_cuts.values()) > RANKED_ROWS and digits < 30:
            inside = {(c, prefix) for (c, _), (prefix, _, _) in open_cuts.items()}
            deeper = self._count(self._within(inside, digits), digits + PREFIX_DIGITS)
            for (c, i), (prefix, rank, _) in list(open_cuts.items()):
                descend((c, i), [f for f in deeper[c] if f[0].startswith(prefix)], rank)
            digits += PREFIX_DIGITS
        inside = {(c, prefix) for (c, _), (prefix, _, _) in open_cuts.items()}
        order = Window.partitionBy("_c", "_p").orderBy("_h")
        ranked = self._within(inside, digits).withColumn("_r", F.row_number().over(order))
        target = local_table(
            self.spark,
            [(c, prefix, rank, i) for (c, i), (prefix, rank, _) in open_cuts.items()],
            f"_c {self.kind}, _p string, _r int, _i int",
        )
        for row in collect_bounded(ranked.join(target, ["_c", "_p", "_r"]).select("_c", "_i", "_h"), "Cuts"):
            result[row["_c"]][row["_i"]] = row["_h"]
        return result


def with_part(
    df: DataFrame, label: str, row_id: str, seed: int, cuts: Mapping[object, Sequence[str]], name: str
) -> DataFrame:
    """Add 0 for rows up to the first cut of their class, 1 up to the second, and so on.

    The hash is its own projection, so it is computed once per row.
    """
    if not cuts:
        raise ValueError("There is no class to split.")
    chosen = None
    for c, listed in cuts.items():
        passed = F.lit(0)
        for cut in listed:
            passed = passed + F.when(F.col("_digest") > F.lit(cut), 1).otherwise(0)
        same = quoted(label) == F.lit(c)
        chosen = F.when(same, passed) if chosen is None else chosen.when(same, passed)
    return df.withColumn("_digest", row_hash(quoted(row_id), seed)).withColumn(name, chosen).drop("_digest")


def check_sizes(train: float, test: float, val: float) -> None:
    if not 0 < train < 1 or not 0 < test < 1 or not 0 <= val < 1:
        raise ValueError("Training and test parts must be shares between 0 and 1; the validation part may also be 0.")
    if not math.isclose(train + test + val, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"The shares of the parts add up to {train + test + val:.3f}, not to 1.")


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    train: float = 0.7,
    test: float = 0.2,
    val: float = 0.1,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Add the column ``split`` with train / val / test, keeping class proportions.

    The test part is taken first; validation is a share of what remains.
    """
    check_sizes(train, test, val)
    order = HashOrder(df, label, row_id, seed)
    counts = order.counts
    if len(counts) < 2:
        raise ValueError("A stratified split of one class has nothing to stratify.")
    total = sum(counts.values())
    rest = total - math.ceil(test * total)
    in_rest = allocate(counts, rest)
    in_test = {c: counts[c] - in_rest[c] for c in counts}
    if val == 0:
        ranks = {c: [in_test[c]] for c in counts}
        names = ["test", "train"]
    else:
        in_train = allocate(in_rest, rest - math.ceil(val / (train + val) * rest))
        ranks = {c: [in_test[c], counts[c] - in_train[c]] for c in counts}
        names = ["test", "val", "train"]
    parts = with_part(df, label, row_id, seed, order.cuts(ranks), name)
    return parts.withColumn(name, F.element_at(F.array(*[F.lit(n) for n in names]), F.col(name) + 1))


def two_way_split(
    df: DataFrame, label: str, row_id: str, test: float, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Stratified split into train and test."""
    return stratified_split(df, label, row_id, 1.0 - test, test, 0.0, seed, name)


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add ``fold`` 1..k with every class spread as evenly as its size allows."""
    if folds < 2:
        raise ValueError("Fewer than two folds cannot be made.")
    order = HashOrder(df, label, row_id, seed)
    counts = order.counts
    if min(counts.values()) < folds:
        raise ValueError("A class has fewer rows than there are folds.")
    ranks = {c: [i * (n // folds) + min(i, n % folds) for i in range(1, folds)] for c, n in counts.items()}
    parts = with_part(df, label, row_id, seed, order.cuts(ranks), name)
    return parts.withColumn(name, F.col(name) + 1)


def inner_split(
    df: DataFrame, label: str, row_id: str, fold: int, train: float, val: float, seed: int, name: str = "split"
) -> DataFrame:
    """Train / val split of the rows outside ``fold``, seeded by the fold."""
    outside = df.where(F.col("fold") != fold)
    parts = two_way_split(outside, label, row_id, val / (train + val), seed + fold, name)
    return parts.withColumn(name, F.when(F.col(name) == "test", "val").otherwise(F.col(name)))


def class_weights(df: DataFrame, label: str) -> dict:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def weight_column(label: str, weights: Mapping[object, float]) -> Column:
    chosen = None
    for c, w in weights.items():
        same = quoted(label) == F.lit(c)
        chosen = F.when(same, F.lit(float(w))) if chosen is None else chosen.when(same, F.lit(float(w)))
    return chosen.otherwise(F.lit(1.0))


def undersample(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Every class down to the size of the smallest one, chosen by hash order."""
    order = HashOrder(df, label, row_id, seed)
    smallest = min(order.counts.values())
    cuts = order.cuts({c: [smallest] for c in order.counts})
    return with_part(df, label, row_id, seed, cuts, "_part").where("_part = 0").drop("_part")


def ranked_by_hash(df: DataFrame, label: str, row_id: str, seed: int, name: str = "_rank") -> DataFrame:
    """Dense 1-based rank within the class in hash order, computed per hash prefix.

    Offsets come from the counts per prefix (at most classes x 65,536 records), so
    only the rows of one prefix are ever sorted together.
    """
    hashed = df.withColumn("_h", row_hash(quoted(row_id), seed)).withColumn("_p", F.substring("_h", 1, RANK_DIGITS))
    sizes = hashed.groupBy(quoted(label).alias("_c"), "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_c", F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(quoted(label), "_p").orderBy("_h")
    joined = hashed.join(offsets, (quoted(label) == F.col("_c")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn(name, F.col("_off") + F.row_number().over(inside)).drop("_h", "_p", "_c", "_q", "_off")


def draw_counts(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame | None:
    """Rows of the smaller classes with the number of times ``_times`` each is drawn.

    Draw k of a class takes the row whose rank is a hash of (seed, class, k) modulo
    the class size, until the class reaches the size of the largest.  Equal draws
    are counted before the join, so a popular row travels once.  None when the
    classes are already balanced.
    """
    counts = class_counts(df, label)
    largest = max(counts.values())
    short = {c: n for c, n in counts.items() if n < largest}
    if not short:
        return None
    spark, label_type = df.sparkSession, df.schema[label].dataType
    draws = None
    for c, n in short.items():
        key = F.md5(F.concat(F.lit(f"{int(seed)}|{c}|"), F.col("id").cast("string")))
        picked = spark.range(largest - n).select(
            F.lit(c).cast(label_type).alias("_dc"), (hash_number(key) % n + 1).alias("_dr")
        )
        draws = picked if draws is None else draws.unionByName(picked)
    times = draws.groupBy("_dc", "_dr").agg(F.count("*").alias("_times"))
    ranked = ranked_by_hash(df.where(quoted(label).isin(list(short))), label, row_id, seed)
    joined = ranked.join(times, (quoted(label) == F.col("_dc")) & (F.col("_rank") == F.col("_dr")))
    return joined.drop("_dc", "_dr", "_rank")


def oversample(df: DataFrame, label: str, row_id: str, seed: int = 42, name: str = "draw") -> DataFrame:
    """Add rows drawn with replacement until every class has the size of the largest.

    ``draw`` counts the copies: 0 for an original row, 1, 2, ... for drawn ones.
    """
    originals = df.withColumn(name, F.lit(0).cast("bigint"))
    drawn = draw_counts(df, label, row_id, seed)
    if drawn is None:
        return originals
    copies = drawn.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return originals.unionByName(copies.select(*originals.columns))


def balance(
    df: DataFrame, label: str, row_id: str, strategy: str = "smote", features: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Balance the classes by one of the three resampling strategies."""
    if strategy == "undersample":
        return undersample(df, label, row_id, seed)
    if strategy == "oversample":
        return oversample(df, label, row_id, seed).drop("draw")
    if strategy == "smote":
        from flowspark.operators.smote import smote

        return smote(df, features, label, row_id, seed=seed)
    raise ValueError(f"There is no balancing by {strategy!r}.")
