"""Feature scores, correlation, variance and the selection pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import edges_passed, quoted
from flowspark.functions.quantiles import column_quantiles
from flowspark.operators.clean import wide_aggregate
from flowspark.operators.features import interactions
from flowspark.operators.neighbours import SCORE_SCHEMA, neighbour_mutual_information
from flowspark.session import local_table

SCORE_METHODS = ("f_classif", "mutual_info", "binned_mutual_info")
PAIR_SCHEMA = "later string, earlier string, correlation double"


def _class_moments(df: DataFrame, features: Sequence[str], label: str) -> list[tuple]:
    """(class, n, {feature: (mean, population variance)}) with a bounded pass width."""
    moments: dict[object, tuple[int, dict]] = {}
    for start in range(0, len(features), 25):
        part = features[start : start + 25]
        rows = df.groupBy(quoted(label).alias("c")).agg(
            F.count("*").alias("n"),
            *[F.avg(quoted(f).cast("double")).alias(f"m{i}") for i, f in enumerate(part)],
            *[F.var_pop(quoted(f).cast("double")).alias(f"v{i}") for i, f in enumerate(part)],
        )
        for row in rows.collect():
            n, known = moments.setdefault(row["c"], (row["n"], {}))
            known.update({f: (row[f"m{i}"], row[f"v{i}"]) for i, f in enumerate(part)})
    return [(c, n, known) for c, (n, known) in moments.items()]


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F score per feature: (feature, position, score).

    Class means and centred second moments combine map-side to one record per
    class; raw sums of squares, which cancel badly, are never formed.
    """
    classes = _class_moments(df, list(features), label)
    rows = sum(n for _, n, _ in classes)
    scores = []
    for position, feature in enumerate(features):
        grand = sum(n * known[feature][0] for _, n, known in classes) / rows
        between = sum(n * (known[feature][0] - grand) ** 2 for _, n, known in classes) / (len(classes) - 1)
        within = sum(n * known[feature][1] for _, n, known in classes) / (rows - len(classes))
        score = between / within if within > 0 else (float("inf") if between > 0 else None)
        scores.append((feature, position, score))
    return local_table(df.sparkSession, scores, SCORE_SCHEMA)


def binned_mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each feature, cut at its quantiles, and the label.

    A plug-in estimate from bin counts, cheaper than the nearest-neighbour estimate and with other values.
    """
    if bins < 2:
        raise ValueError("Mutual information needs two bins or more.")
    inner = [i / bins for i in range(1, bins)]
    edges = {f: set(found.values()) for f, found in column_quantiles(df, features, inner).items()}
    coded = df.select(
        quoted(label).alias("_y"),
        *[edges_passed(quoted(f).cast("double"), sorted(edges.get(f, ()))).alias(f) for f in features],
    ).unpivot(["_y"], [quoted(f) for f in features], "feature", "bin")
    cells = coded.where("bin IS NOT NULL").groupBy("feature", "bin", "_y").agg(F.count("*").cast("double").alias("n"))
    per_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    per_class = cells.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("nt"))
    joined = cells.join(per_bin, ["feature", "bin"]).join(per_class, ["feature", "_y"]).join(total, "feature")
    share = F.col("n") / F.col("nt")
    term = share * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    places = local_table(df.sparkSession, list(zip(features, range(len(features)))), "feature string, position int")
    scores = joined.groupBy("feature").agg(F.sum(term).alias("score"))
    return places.join(scores, "feature", "left").select("feature", "position", "score")


def feature_scores(df: DataFrame, features: Sequence[str], label: str, method: str = "f_classif") -> DataFrame:
    if method not in SCORE_METHODS:
        raise ValueError(f"A feature score must be one of {SCORE_METHODS}, not {method!r}.")
    scores = {"f_classif": anova_f, "mutual_info": neighbour_mutual_information, "binned_mutual_info": binned_mutual_information}
    return scores[method](df, features, label)


def top_features(
    df: DataFrame, features: Sequence[str], label: str, k: int = 20, method: str = "f_classif"
) -> list[str]:
    """The k best scored features in their original order."""
    if not isinstance(k, int) or k < 1:
        raise ValueError("The number of features to select must be a whole number above 0.")
    scores = feature_scores(df, features, label, method)
    best = scores.orderBy(F.desc_nulls_last("score"), "position").limit(k)
    return [r["feature"] for r in best.orderBy("position").collect()]


def project(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Apply a learned or fixed feature list; an absent feature is an error."""
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"Input is missing selected features: {missing}")
    return df.select(*[quoted(c) for c in [*features, *keep]])


def low_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Features whose population variance does not exceed the threshold."""
    variances = wide_aggregate(df, {(f,): F.var_pop(quoted(f).cast("double")) for f in features})
    rows = [(f, variances[f,]) for f in features if variances[f,] is not None and variances[f,] <= threshold]
    return local_table(df.sparkSession, rows, "feature string, variance double")


def correlations(df: DataFrame, features: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pearson correlation of every (earlier, later) pair over the rows that have both; undefined ones are absent.

    One scan for any number of columns, with or without gaps: with m the mask of what is there and x the values less
    their means, 0 where missing, the products m'm, x'm, x'x and (x x)'m hold the counts, sums, cross sums and
    squares of all pairs.  A task adds them up and hands out one row a pair.
    """
    centre = wide_aggregate(df, {(f, k): fold(quoted(f).cast("double")) for f in features for k, fold in (("mean", F.avg), ("low", F.min), ("high", F.max))})
    # A constant column is moved to exactly 0.
    shift = np.array([(centre[f, "low"] if centre[f, "low"] == centre[f, "high"] else centre[f, "mean"]) or 0.0 for f in features])
    shift = np.where(np.isfinite(shift), shift, 0.0)
    width = len(features)

    def products(batches):
        total = np.zeros((4, width, width))
        for b in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.columns]) - shift[:, None]
            x = np.where(there > 0, x, 0.0)
            total += np.stack([there @ there.T, x @ there.T, x @ x.T, (x * x) @ there.T])
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, *total.reshape(4, -1))], ["i", "j", "n", "s", "p", "q"])

    columns = [quoted(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    parts = df.select(*columns).mapInArrow(products, "i long, j long, n double, s double, p double, q double")
    summed = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nspq"]).toArrow()
    n, s, p, q = (np.zeros((width, width)) for _ in range(4))
    place = summed.column("i").to_numpy(), summed.column("j").to_numpy()
    for name, m in zip("nspq", (n, s, p, q)):
        m[place] = summed.column(name).to_numpy()
    spread = n * q - s * s  # of the row's feature over the rows that the pair shares
    spread = np.where(spread > 1e-13 * n * q, spread, np.nan)
    with np.errstate(invalid="ignore"):
        r = (n * p - s * s.T) / np.sqrt(spread * spread.T)
    return {(a, b): float(r[i, j]) for (i, a), (j, b) in combinations(enumerate(features), 2) if np.isfinite(r[i, j])}


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Pairs (later, earlier, |r|) with |r| above the threshold."""
    rows = [(b, a, abs(r)) for (a, b), r in correlations(df, features).items() if abs(r) > threshold]
    return local_table(df.sparkSession, rows, PAIR_SCHEMA)


def correlated_features(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Features too close to any earlier feature, even to one that goes itself."""
    dropped = {b for (a, b), r in correlations(df, features).items() if abs(r) > threshold}
    return [f for f in features if f in dropped]


@dataclass(frozen=True)
class FeaturePlan:
    """Learned feature schema: which inputs stay, which products are made, what is selected."""

    inputs: tuple[str, ...]
    with_interactions: bool
    selected: tuple[str, ...]


def fit_features(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    *,
    remove_correlated: bool = True,
    correlation_threshold: float = 0.95,
    create_interactions: bool = False,
    n_features: int | None = None,
    method: str = "f_classif",
    fixed: Sequence[str] | None = None,
) -> FeaturePlan:
    """Drop correlated columns, optionally add products, keep the best scored.

    A fixed list bypasses everything that is learned.
    """
    if fixed:
        project(df, fixed)
        return FeaturePlan(tuple(fixed), False, tuple(fixed))
    inputs = list(features)
    if remove_correlated:
        gone = set(correlated_features(df, inputs, correlation_threshold))
        inputs = [f for f in inputs if f not in gone]
    products = create_interactions
    selected = inputs
    data = df
    if products:
        data = interactions(project(df, inputs, [label] if label else []), inputs)
        selected = [c for c in data.columns if c != label]
    if n_features is not None and label is not None:
        selected = top_features(data, selected, label, n_features, method)
    return FeaturePlan(tuple(inputs), products, tuple(selected))


def apply_features(df: DataFrame, plan: FeaturePlan, keep: Sequence[str] = ()) -> DataFrame:
    """Bring any table with the training inputs to the learned feature schema."""
    if plan.with_interactions:
        df = interactions(project(df, plan.inputs, keep), list(plan.inputs))
    return project(df, plan.selected, keep)


def importance_stability(importances: DataFrame, folds: int) -> DataFrame:
    """Mean, sample deviation and selection frequency of each feature over the folds."""
    return (
        importances.groupBy("feature")
        .agg(
            F.avg("importance").alias("mean_importance"),
            F.stddev_samp("importance").alias("std_importance"),
            F.count_distinct("fold").alias("folds_selected"),
        )
        .withColumn("selection_frequency", F.col("folds_selected").cast("double") / folds)
        .orderBy(F.desc("mean_importance"), "feature")
    )
