"""Support vector machines: a linear solver over standardised or random Fourier features.

The radial kernel exp(-gamma |x - y|^2) is the mean of cos(w (x - y)) over normal w, so that ``components`` random
cosines of a row stand for the kernel: their dot products differ from it by about 1 / sqrt(components).  The solver then
sees a plain table of rows, which needs no row beside another one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowspark.functions.expr import quoted
from flowspark.session import materialize, ship_package

KERNELS = ("linear", "rbf")


class Machine(NamedTuple):
    """Everything a score needs.  Without ``waves`` the kernel is linear."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray  # [feature, component]
    phases: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float  # of the logistic curve over margins
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return mapped(x, self.mean, self.scale, self.waves, self.phases) @ self.weights + self.intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -700, 700)))


def mapped(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, waves: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Standardised rows, or their random Fourier features."""
    z = (x - mean) / scale
    return np.sqrt(2 / len(phases)) * np.cos(z @ waves + phases) if len(phases) else z


def _matrix(series: Sequence[pd.Series]) -> np.ndarray:
    return np.stack([s.to_numpy(float, na_value=np.nan) for s in series], axis=1)


def fit_machine(df: DataFrame, features: Sequence[str], label: str, p: Mapping) -> Machine:
    """Fit on the 0/1 column ``label``; ``gamma="scale"`` is one over the number of features that vary."""
    if p["kernel"] not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}: others have no sum over rows that stands for them.")
    ship_package(df.sparkSession)
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*[quoted(f).cast("double").alias(n) for f, n in zip(features, names)], quoted(label).cast("double").alias("label"))
    # Equal rows are one row with a weight, which is what every sum below sees of them.
    rows = materialize(rows.groupBy(*names, "label").agg(F.count("*").cast("double").alias("weight")), "machine-rows")
    stats = df.select(*[quoted(f).cast("double").alias(n) for f, n in zip(features, names)]).agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    mean, spread = (np.array([stats[f"{c}{n}"] or 0.0 for n in names]) for c in "ms")
    scale, varying = np.where(spread > 0, spread, 1.0), max(1, int((spread > 0).sum()))
    waves, phases = np.zeros((len(names), 0)), np.zeros(0)
    if p["kernel"] == "rbf":
        gamma = 1 / varying if p["gamma"] == "scale" else 1 / len(names) if p["gamma"] == "auto" else float(p["gamma"])
        rng = np.random.default_rng(p["random_state"])
        waves = np.sqrt(2 * gamma) * rng.normal(size=(len(names), p["components"]))
        phases = rng.uniform(0, 2 * np.pi, p["components"])

    @pandas_udf("array<double>")
    def spread_out(*series: pd.Series) -> pd.Series:
        return pd.Series(list(mapped(_matrix(series), mean, scale, waves, phases)))

    wide = rows.select(array_to_vector(spread_out(*names)).alias("features"), "label", "weight")
    solver = LinearSVC(weightCol="weight", regParam=1 / (p["C"] * max(stats["n"], 1)), maxIter=p["max_iter"], tol=p["tol"], standardization=False)
    linear = solver.fit(wide)
    weights, intercept = linear.coefficients.toArray(), float(linear.intercept)
    machine = Machine(mean, scale, waves, phases, weights, intercept, 1.0, 0.0)

    @pandas_udf("double")
    def margin(*series: pd.Series) -> pd.Series:
        return pd.Series(machine.margin(_matrix(series)))

    margins = materialize(rows.select(margin(*names).alias("margin"), "label", "weight"), "margins")
    curve = LogisticRegression(regParam=1e-6, weightCol="weight").fit(margins.select(array_to_vector(F.array("margin")).alias("features"), "label", "weight"))
    return machine._replace(slope=float(curve.coefficients[0]), offset=float(curve.intercept))


def probability(spark: SparkSession, machine: Machine, columns: Sequence[Column]) -> Column:
    """Probability of class 1 as a column over double columns."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(_matrix(series)))

    return score(*columns)
