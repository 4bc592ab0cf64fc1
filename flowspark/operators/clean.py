"""Deduplication, missing values, outliers, and uninformative columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.expr import finite, long_form, quoted
from flowspark.functions.quantiles import column_quantiles
from flowspark.functions.sequence import fill_gaps, with_sequence
from flowspark.session import materialize

MISSING_STRATEGIES = ("drop", "mean", "median", "forward_fill")
OUTLIER_DEFAULTS = {"iqr": 1.5, "zscore": 3.0}
AGGREGATES_PER_PASS = 60


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in schema order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def clear_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    floating = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(quoted(c)) for c in floating})


def wide_aggregate(df: DataFrame, makers: Mapping[tuple, Column]) -> dict[tuple, object]:
    """Evaluate many scalar aggregates, a bounded number per pass.

    A single aggregate over hundreds of expressions outgrows generated code, so
    wide tables are scanned a few times with column-pruned reads instead.
    """
    items = list(makers.items())
    values: dict[tuple, object] = {}
    for start in range(0, len(items), AGGREGATES_PER_PASS):
        part = items[start : start + AGGREGATES_PER_PASS]
        row = df.agg(*[expression.alias(f"a{i}") for i, (_, expression) in enumerate(part)]).first()
        values.update({key: row[i] for i, (key, _) in enumerate(part)})
    return values


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows; NULL equals NULL.

    With a subset the first row in ``order_by`` is kept.  Both forms are plain
    aggregates, so copies of one row collapse before the shuffle however many
    there are.
    """
    if subset is None:
        return df.distinct()
    if not order_by:
        raise ValueError("Keeping the first row of a subset needs order_by.")
    rest = [c for c in df.columns if c not in set(subset)]
    if not rest:
        return df.select(*[quoted(c) for c in subset]).distinct()
    kept, order = (F.struct(*[quoted(c) for c in columns]) for columns in (rest, order_by))
    # What is kept is often what orders: then it travels once.
    first = F.min(kept) if rest == list(order_by) else F.min_by(kept, order)
    kept = df.groupBy(*[quoted(c) for c in subset]).agg(first.alias("_kept"))
    return kept.select(*[quoted(c) if c in set(subset) else F.col("_kept")[c].alias(c) for c in df.columns])


def fit_fill(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, float]:
    """Column means or exact medians, ignoring missing and non-finite values."""
    if strategy not in ("mean", "median"):
        raise ValueError("Fill values are fitted for 'mean' and 'median' only.")
    clean = clear_non_finite(df, columns)
    if strategy == "mean":
        found = wide_aggregate(clean, {(c,): F.avg(quoted(c).cast("double")) for c in columns})
        return {c: v for (c,), v in found.items() if v is not None}
    return {c: found[0.5] for c, found in column_quantiles(clean, columns, [0.5]).items()}


def apply_fill(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(quoted(c).cast("double")), F.lit(float(v))) for c, v in values.items()})


def handle_missing(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "drop",
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Drop, impute or carry values over gaps in ``columns``; NaN and infinities are gaps like NULL."""
    if strategy not in MISSING_STRATEGIES:
        raise ValueError(f"Missing values are handled by one of {list(MISSING_STRATEGIES)}, not by {strategy!r}.")
    df = clear_non_finite(df, columns)
    if strategy == "drop":
        return df.na.drop("any", subset=list(columns))
    if strategy == "forward_fill":
        return forward_fill(df, columns, order_by, partition_by)
    return apply_fill(df, fit_fill(df, columns, strategy))


def forward_fill(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Carry the last known value forward, then fill leading gaps backwards."""
    if not order_by:
        raise ValueError("forward_fill needs order_by columns that identify a row.")
    ordered = with_sequence(clear_non_finite(df, columns), [*partition_by, *order_by], "_seq")
    return fill_gaps(ordered, columns, partition_by, "_seq").drop("_seq")


def fit_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float | None = None, guarded: bool = False
) -> dict[str, tuple[float, float]]:
    """Allowed closed range per column.

    ``iqr`` uses exact quartiles.  ``zscore`` uses the population deviation; a
    constant column gets no range because nothing in it can be an outlier.  ``guarded`` says that no value is
    NaN or infinite, so that none is looked for.
    """
    if method not in OUTLIER_DEFAULTS:
        raise ValueError(f"Outliers are found by one of {list(OUTLIER_DEFAULTS)}, not by {method!r}.")
    limit = OUTLIER_DEFAULTS[method] if threshold is None else float(threshold)
    ranges: dict[str, tuple[float, float]] = {}
    df = df if guarded else clear_non_finite(df, columns)
    if method == "iqr":
        for column, found in column_quantiles(df, columns, [0.25, 0.75]).items():
            spread = found[0.75] - found[0.25]
            ranges[column] = (found[0.25] - limit * spread, found[0.75] + limit * spread)
        return ranges
    moments = wide_aggregate(
        df,
        {
            **{(c, "mean"): F.avg(quoted(c).cast("double")) for c in columns},
            **{(c, "std"): F.stddev_pop(quoted(c).cast("double")) for c in columns},
        },
    )
    for column in columns:
        mean, std = moments[column, "mean"], moments[column, "std"]
        if std:
            ranges[column] = (mean - limit * std, mean + limit * std)
    return ranges


def outlier_flag(ranges: Mapping[str, tuple[float, float]], guarded: bool = False) -> Column:
    """True when any column lies outside its range; missing values never do."""
    flag = F.lit(False)
    for column, (low, high) in ranges.items():
        value = quoted(column).cast("double") if guarded else finite(quoted(column).cast("double"))
        outside = (value < F.lit(low)) | (value > F.lit(high))
        flag = flag | F.coalesce(outside, F.lit(False))
    return flag


def remove_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float | None = None, guarded: bool = False
) -> DataFrame:
    return df.where(~outlier_flag(fit_outliers(df, columns, method, threshold, guarded), guarded))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with exactly one distinct present value (min equals max)."""
    edges = wide_aggregate(
        clear_non_finite(df, columns),
        {
            **{(c, "min"): F.min(quoted(c)) for c in columns},
            **{(c, "max"): F.max(quoted(c)) for c in columns},
        },
    )
    return [c for c in columns if edges[c, "min"] is not None and edges[c, "min"] == edges[c, "max"]]


def quasi_constant_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> dict[str, float]:
    """Columns whose most frequent value covers more than ``threshold`` of all rows.

    A value that covers over half of the rows is the median, and the sketch that
    finds the median cannot miss it while its share is clear of one half by the
    sketch error.  So two scans with no shuffle of values decide every column.
    Smaller thresholds count the values instead.
    """
    df = clear_non_finite(df, columns)
    if threshold >= 0.55:
        medians = wide_aggregate(df, {(c,): F.percentile_approx(quoted(c).cast("double"), 0.5, 1000) for c in columns})
        known = {c: v for (c,), v in medians.items() if v is not None}
        makers = {(c,): F.count(F.when(quoted(c).cast("double") == F.lit(v), 1)) for c, v in known.items()}
        hits = wide_aggregate(df, {**makers, (None,): F.count(F.lit(1))})
        total = hits[None,]
        shares = {c: hits[c,] / total for c in known}
    else:
        total = df.count()
        counts = long_form(df, columns).where("value IS NOT NULL").groupBy("feature", "value").count()
        shares = {r["feature"]: r["n"] / total for r in counts.groupBy("feature").agg(F.max("count").alias("n")).collect()}
    return {c: shares[c] for c in columns if shares.get(c, 0.0) > threshold}


def uninformative_columns(df: DataFrame, columns: Sequence[str], threshold: float) -> tuple[list[str], list[str]]:
    """Constant columns and, of the others, those with a dominant value, of rows without NaN and infinities.

    Extremes and medians come from one scan, the medians' shares from a second.
    """
    folds = {"min": F.min, "max": F.max} | ({"median": lambda c: F.percentile_approx(c.cast("double"), 0.5, 1000)} if threshold >= 0.55 else {})
    found = wide_aggregate(df, {(c, k): fold(quoted(c)) for c in columns for k, fold in folds.items()})
    constant = [c for c in columns if found[c, "min"] is not None and found[c, "min"] == found[c, "max"]]
    rest = [c for c in columns if c not in constant]
    if threshold < 0.55 or not rest:
        return constant, list(quasi_constant_columns(df, rest, threshold)) if rest else []
    known = [c for c in rest if found[c, "median"] is not None]
    makers = {(c,): F.count(F.when(quoted(c).cast("double") == F.lit(found[c, "median"]), 1)) for c in known}
    hits = wide_aggregate(df, {**makers, (None,): F.count(F.lit(1))})
    return constant, [c for c in known if hits[c,] / hits[None,] > threshold]


@dataclass
class CleaningPlan:
    """What the training data taught the cleaning step; reusable on other data."""

    features: list[str]
    strategy: str
    fill: dict[str, float] = field(default_factory=dict)  # of the rows without duplicates
    holdout_fill: dict[str, float] = field(default_factory=dict)  # of all rows as they came
    constant: list[str] = field(default_factory=list)
    quasi_constant: list[str] = field(default_factory=list)


def clean_training(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    *,
    deduplicate: bool = True,
    strategy: str = "drop",
    outliers: str | None = "iqr",
    outlier_threshold: float = 1.5,
    drop_constant: bool = True,
    quasi_threshold: float = 0.95,
    order_by: Sequence[str] = (),
) -> tuple[DataFrame, CleaningPlan]:
    """Non-finite values, duplicates, gaps, outliers, then uninformative columns.

    Only features and label survive: duplicates are defined over exactly these, and
    rows that agree on the features but not on the label are both kept.
    """
    features = list(features)
    carried = [label] if label else []
    order = [c for c in order_by if c not in features and c not in carried]
    plan = CleaningPlan(features=features, strategy=strategy)
    data = clear_non_finite(df.select(*[quoted(c) for c in [*features, *carried, *order]]), features)
    if strategy in ("mean", "median"):
        plan.holdout_fill = fit_fill(data, features, strategy)
    if deduplicate:
        if order:
            data = remove_duplicates(data, [*features, *carried], order)
        else:
            data = remove_duplicates(data)
    if strategy in ("mean", "median"):
        plan.fill = fit_fill(data, features, strategy) if deduplicate else plan.holdout_fill
        data = apply_fill(data, plan.fill)
    elif strategy == "drop":
        data = data.na.drop("any", subset=features)
    else:
        data = handle_missing(data, features, strategy, order)
    # The passes below read the deduplicated rows several times; they are written once, without NaN and infinities.
    data = materialize(data, "cleaned")
    if outliers:
        data = remove_outliers(data, features, outliers, outlier_threshold, guarded=True)
    if drop_constant:
        plan.constant, plan.quasi_constant = uninformative_columns(data, features, quasi_threshold)
        plan.features = [c for c in features if c not in {*plan.constant, *plan.quasi_constant}]
    return data.select(*[quoted(c) for c in [*plan.features, *carried, *order]]), plan


def clean_holdout(
    df: DataFrame,
    plan: CleaningPlan,
    all_features: Sequence[str],
    keep: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Prepare held-out rows with nothing learned from them.

    Holdouts are never deduplicated or filtered for outliers; gaps take the values of the training rows
    before these lost their duplicates.  Rows with gaps go by
    all features present, before the projection onto the training columns.
    """
    missing = [c for c in plan.features if c not in df.columns]
    if missing:
        raise ValueError(f"Columns known from training are not in the holdout: {missing}")
    present = [c for c in all_features if c in df.columns]
    data = clear_non_finite(df, present)
    if plan.strategy in ("mean", "median"):
        data = apply_fill(data, {c: v for c, v in plan.holdout_fill.items() if c in df.columns})
    else:
        data = handle_missing(data, present, plan.strategy, order_by)
    return data.select(*[quoted(c) for c in [*plan.features, *keep]])
