"""Min-max, z-score and robust scaling as fitted shift/scale pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.expr import quoted
from flowspark.functions.quantiles import column_quantiles
from flowspark.operators.clean import wide_aggregate
from flowspark.session import local_table

METHODS = ("minmax", "zscore", "robust")
PARAMETER_SCHEMA = "feature string, position int, shift double, scale double"


@dataclass(frozen=True)
class Scaler:
    """Ordered feature names with ``(x - shift) / scale`` for each."""

    method: str
    features: tuple[str, ...]
    shift: tuple[float, ...]
    scale: tuple[float, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.features, range(len(self.features)), self.shift, self.scale))
        return local_table(spark, rows, PARAMETER_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame, method: str) -> "Scaler":
        rows = sorted(table.collect(), key=lambda r: r["position"])
        return Scaler(
            method,
            tuple(r["feature"] for r in rows),
            tuple(r["shift"] for r in rows),
            tuple(r["scale"] for r in rows),
        )


def check_columns(df: DataFrame, features: Sequence[str]) -> None:
    """Reject absent and non-numeric feature columns; looks at the schema only."""
    if not features:
        raise ValueError("There are no features to scale.")
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"Input is missing features: {absent}")
    text = [c for c in features if not isinstance(df.schema[c].dataType, T.NumericType)]
    if text:
        raise ValueError(f"Columns of text cannot be scaled: {text}")


def _extent(features: Sequence[str]) -> dict:
    values = {c: quoted(c).cast("double") for c in features}
    return {
        (None, "rows"): F.count(F.lit(1)),
        **{(c, "n"): F.count(v) for c, v in values.items()},
        **{(c, "min"): F.min(v) for c, v in values.items()},
        **{(c, "max"): F.max(v) for c, v in values.items()},
    }


def _check_extent(found: dict, features: Sequence[str]) -> None:
    """Complete columns whose ends are finite hold finite values only (NaN sorts last)."""
    if not found[None, "rows"]:
        raise ValueError("There is no row to fit a scaler to.")
    for c in features:
        whole = found[c, "n"] == found[None, "rows"]
        if not whole or not math.isfinite(found[c, "min"]) or not math.isfinite(found[c, "max"]):
            raise ValueError("A scaler cannot be fitted to missing or infinite values.")


def validate_features(df: DataFrame, features: Sequence[str]) -> None:
    """Reject empty, non-numeric, missing or non-finite feature data."""
    check_columns(df, features)
    _check_extent(wide_aggregate(df, _extent(features)), features)


def fit_scaler(df: DataFrame, features: Sequence[str], method: str = "minmax") -> Scaler:
    """Learn one shift and one scale per feature; a zero spread divides by one.

    Validation rides on the same aggregate as the statistics.
    """
    if method not in METHODS:
        raise ValueError(f"There is no scaling by {method!r}.")
    check_columns(df, features)
    wanted = _extent(features)
    if method == "zscore":
        wanted.update({(c, "mean"): F.avg(quoted(c).cast("double")) for c in features})
        wanted.update({(c, "std"): F.stddev_pop(quoted(c).cast("double")) for c in features})
    found = wide_aggregate(df, wanted)
    _check_extent(found, features)
    if method == "minmax":
        pairs = [(found[c, "min"], found[c, "max"] - found[c, "min"]) for c in features]
    elif method == "zscore":
        pairs = [(found[c, "mean"], found[c, "std"]) for c in features]
    else:
        quartiles = column_quantiles(df, features, [0.25, 0.5, 0.75])
        pairs = [(quartiles[c][0.5], quartiles[c][0.75] - quartiles[c][0.25]) for c in features]
    return Scaler(
        method, tuple(features), tuple(float(a) for a, _ in pairs), tuple(float(b) or 1.0 for _, b in pairs)
    )


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scale in place; new data may leave the fitted range and is not clipped."""
    missing = [c for c in scaler.features if c not in df.columns]
    if missing:
        raise ValueError(f"Columns the scaler was fitted on are missing: {missing}")
    return df.withColumns(
        {
            c: (quoted(c).cast("double") - F.lit(a)) / F.lit(b)
            for c, a, b in zip(scaler.features, scaler.shift, scaler.scale)
        }
    )


def require_schema(df: DataFrame, features: Sequence[str], other: Sequence[str] = ()) -> None:
    """Exact ordered equality of the feature columns."""
    actual = [c for c in df.columns if c not in set(other)]
    if actual != list(features):
        raise ValueError(f"The scaler was fitted on {list(features)}; these columns are others: {actual}.")
