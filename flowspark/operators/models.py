"""Classifiers, scoring, importances and hyperparameter search."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import decide, quoted
from flowspark.functions.hashing import row_hash
from flowspark.functions.sequence import with_sequence
from flowspark.operators import kernels, trees
from flowspark.operators.labels import check_labels, check_trainable
from flowspark.operators.metrics import ranking_scores
from flowspark.operators.permutation import permuted_precisions
from flowspark.operators.split import stratified_folds
from flowspark.session import discard, local_table, materialize

DEEPEST_TREE = 30  # stands for an unlimited depth in the search

# Accepted hyperparameters and their defaults per algorithm.
DEFAULTS = {
    "random_forest": {
        "n_estimators": 100, "max_depth": 20, "min_samples_split": 5, "min_samples_leaf": 2,
        "max_features": "sqrt", "class_weight": "balanced", "random_state": 42,
    },
    "gbt": {
        "n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8, "colsample_bytree": 0.8,
        "min_child_weight": 1.0, "reg_lambda": 1.0, "scale_pos_weight": 1.0, "random_state": 42,
    },
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "components": 512, "max_iter": 100, "tol": 1e-4, "random_state": 42},
}

# The randomized search space.
SEARCH_SPACE = {
    "random_forest": {
        "n_estimators": [100, 200, 300], "max_depth": [8, 12, 16, DEEPEST_TREE],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"], "class_weight": ["balanced", "balanced_subsample"],
    },
    "gbt": {
        "n_estimators": [150, 250, 350], "max_depth": [4, 6, 8, 10],
        "learning_rate": [0.02, 0.05, 0.1], "subsample": [0.7, 0.8, 0.9],
        "colsample_bytree": [0.7, 0.8, 0.9], "min_child_weight": [1.0, 3.0, 5.0],
        "reg_lambda": [0.5, 1.0, 2.0], "scale_pos_weight": [1.0, 1.1, 1.25],
    },
}


def resolve_parameters(kind: str, given: Mapping | None = None) -> dict:
    """Defaults overridden by the given values; a parameter of another algorithm is refused."""
    if kind not in DEFAULTS:
        raise ValueError(f"A model is one of {sorted(DEFAULTS)}, not {kind!r}.")
    unknown = sorted(set(given or {}) - set(DEFAULTS[kind]))
    if unknown:
        raise TypeError(f"A {kind} has no parameters {unknown}.")
    return {**DEFAULTS[kind], **(given or {})}


def check_parameters(kind: str, given: Mapping | None = None) -> dict:
    """All parameters of a model type, refused where no fit could use them."""
    p = resolve_parameters(kind, given)
    if "max_depth" in p and not (isinstance(p["max_depth"], int) and 0 <= p["max_depth"] <= DEEPEST_TREE):
        raise ValueError(f"max_depth must be a number from 0 to {DEEPEST_TREE}, not {p['max_depth']}.")
    if p.get("n_estimators", 1) < 1:
        raise ValueError("n_estimators must be positive.")
    if kind == "svm" and p["kernel"] not in kernels.KERNELS:
        raise ValueError(f"kernel must be one of {kernels.KERNELS}.")
    return p


@dataclass
class TrainedModel:
    """A fitted classifier with the ordered features it expects."""

    kind: str
    features: tuple[str, ...]
    fitted: trees.Ensemble | trees.Stored | kernels.Machine

    @property
    def has_importances(self) -> bool:
        return isinstance(self.fitted, (trees.Ensemble, trees.Stored))


def _fit_trees(kind: str, blocks: DataFrame, edges: list, fits: Mapping) -> dict[int, trees.Ensemble]:
    return (trees.fit_forest if kind == "random_forest" else trees.fit_boosted)(blocks, edges, fits)


def train(df: DataFrame, features: Sequence[str], kind: str = "random_forest", parameters: Mapping | None = None) -> TrainedModel:
    """Fit a classifier on the 0/1 column ``label``; one-class data is refused."""
    p = check_parameters(kind, parameters)
    check_trainable(df, "label")
    if kind == "svm":
        return TrainedModel(kind, tuple(features), kernels.fit_machine(df, features, "label", p))
    edges = trees.fit_bins(df, features)
    return TrainedModel(kind, tuple(features), _fit_trees(kind, trees.binned(df, features, "label", edges), edges, {0: (p, 0)})[0])


def attack_probability(df: DataFrame, model: TrainedModel, name: str = "probability") -> DataFrame:
    """Add the probability of class 1; every input column stays as it was."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"Columns the model was trained on are missing: missing required {missing}")
    columns = [quoted(f).cast("double") for f in model.features]
    spark = df.sparkSession
    if isinstance(model.fitted, trees.Stored):
        return trees.stored_probability(df, model.fitted, columns, name)
    if model.has_importances:
        score = trees.probability(spark, model.fitted, model.kind == "gbt", columns)
    else:
        score = kernels.probability(spark, model.fitted, columns)
    return df.select(*[quoted(c) for c in df.columns if c != name], score.alias(name))


def predict(df: DataFrame, model: TrainedModel, threshold: float = 0.5) -> DataFrame:
    """Add ``probability`` and the decision ``prediction``."""
    return attack_probability(df, model).withColumn("prediction", decide(F.col("probability"), threshold))


def accuracy(df: DataFrame, model: TrainedModel, label: str = "label") -> float:
    scored = predict(df, model)
    return scored.agg(F.avg(F.when(quoted(label) == F.col("prediction"), 1.0).otherwise(0.0))).first()[0]


def feature_importance(df_or_session, model: TrainedModel) -> DataFrame:
    """(feature, importance) of a tree model, normalised over its trees."""
    if not model.has_importances:
        raise ValueError("Only tree models have importances of their own.")
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    values = trees.importances(model.fitted, len(model.features), model.kind == "gbt")
    return local_table(spark, [(f, float(v)) for f, v in zip(model.features, values)], "feature string, importance double")


def shuffled_donor(df: DataFrame, features: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Give every row the feature values of another row: one random cycle over the table.

    Rows are numbered in the order of a seeded hash; each takes the values of its successor, the last those of the
    first.  The order is one range shuffle, so no task sees more than its range.
    """
    ordered = with_sequence(df.withColumn("_h", row_hash(quoted(row_id), seed)), ["_h", row_id], "_turn").drop("_h")
    rows = ordered.count()
    donors = ordered.select(F.pmod(F.col("_turn") - 1, F.lit(max(rows, 1))).alias("_turn"), F.struct(*[quoted(f) for f in features]).alias("_donor"))
    return ordered.join(donors, "_turn").drop("_turn")


def permutation_importance(
    df: DataFrame, model: TrainedModel, label: str, row_id: str, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Loss of average precision when one feature is permuted.

    ``df`` holds scaled features.  Each repeat permutes whole rows once; a variant
    replaces one feature by the donor's value, so all features of a repeat share
    the shuffle.  Repeats run one after another and leave nothing behind on disk.
    """
    if repeats < 1:
        raise ValueError("repeats must be at least 1.")
    check_labels(df, label)
    if isinstance(model.fitted, trees.Stored):
        baseline, losses = _written_losses(df, model, label, row_id, repeats, seed)
    else:
        baseline, found = permuted_precisions(df, model, label, row_id, repeats, seed)
        losses = local_table(df.sparkSession, [(f, None if p is None else baseline - p) for f, _, p in found], "feature string, loss double")
    return (
        losses.groupBy("feature")
        .agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))
        .withColumn("baseline_average_precision", F.lit(baseline).cast("double"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def _written_losses(df: DataFrame, model: TrainedModel, label: str, row_id: str, repeats: int, seed: int) -> tuple[float, DataFrame]:
    """(feature, loss) by a forest that is a written table: rows are scored where its trees lie, a repeat at a time."""
    features = list(model.features)
    base = df.select(quoted(row_id).alias("_id"), quoted(label).alias("_y"), *[quoted(f) for f in features])
    base = materialize(base, "permuted")
    baseline = ranking_scores(attack_probability(base, model), "_y", "probability").first()["pr_auc"]
    found = []
    for k in range(repeats):
        donated = shuffled_donor(base, features, "_id", seed + k)
        changed = donated.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features]))).select(
            "_y", "_feature", *[F.when(F.col("_feature") == f, F.col("_donor")[f]).otherwise(quoted(f)).alias(f) for f in features]
        )
        # Ranking reads the scores twice; they are computed once, and equal ones are counted.
        scored = attack_probability(changed, model).groupBy("_feature", "_y", "probability").agg(F.count("*").alias("_count"))
        scored = materialize(scored, "permuted-scores")
        found += [(r["_feature"], None if r["pr_auc"] is None else baseline - r["pr_auc"]) for r in ranking_scores(scored, "_y", "probability", ["_feature"], "_count").collect()]
        discard(scored)
    return baseline, local_table(df.sparkSession, found, "feature string, loss double")


def sample_parameters(kind: str, base: Mapping, iterations: int, seed: int, space: Mapping | None = None) -> list[dict]:
    """Distinct random candidates; no more than the space holds."""
    space = space or SEARCH_SPACE.get(kind)
    if not space:
        raise ValueError(f"Only {sorted(SEARCH_SPACE)} can be searched.")
    sizes = [len(v) for v in space.values()]
    total = int(np.prod(sizes))
    picks = np.random.default_rng(seed).choice(total, size=min(iterations, total), replace=False)
    chosen = []
    for pick in picks:
        digits = np.unravel_index(int(pick), sizes)
        chosen.append({**base, **{name: space[name][d] for name, d in zip(space, digits)}})
    return chosen


def randomized_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    kind: str,
    base: Mapping | None = None,
    iterations: int = 10,
    folds: int = 3,
    seed: int = 42,
    space: Mapping | None = None,
) -> tuple[dict, DataFrame]:
    """Rank sampled candidates by average precision over stratified folds.

    Rows get their fold once and are stored as blocks of codes; all fits of all candidates then run beside one another
    in one job, and one more job scores every distinct row by the models that left its fold out.  Scaling would not change a
    tree, which only compares values of one feature, so none is fitted.
    """
    if iterations < 1 or folds < 2:
        raise ValueError("A search needs a candidate and two folds at least.")
    from flowspark.operators.clean import clear_non_finite

    check_labels(df, label, allow_missing=True)
    candidates = [check_parameters(kind, c) for c in sample_parameters(kind, dict(base or {}), iterations, seed, space)]
    given = sample_parameters(kind, dict(base or {}), iterations, seed, space)
    clean = clear_non_finite(
        df.select(quoted(row_id).alias("_id"), *[quoted(f) for f in features], quoted(label).alias("label")), features
    ).na.drop("any")
    folded = materialize(stratified_folds(clean, "label", "_id", folds, seed), "search-folds")
    check_trainable(folded, "label")
    edges = trees.fit_bins(folded, features)
    blocks = trees.binned(folded, features, "label", edges, F.col("fold"))
    fits = {c * folds + f: (p, f + 1) for c, p in enumerate(candidates) for f in range(folds)}
    models = _fit_trees(kind, blocks, edges, fits)
    if any(isinstance(m, trees.Stored) for m in models.values()):
        parts = []
        for n, model in models.items():
            held = folded.where(F.col("fold") == n % folds + 1)
            columns = [quoted(f).cast("double") for f in features]
            scored = trees.stored_probability(held, model, columns, "score") if isinstance(model, trees.Stored) else held.withColumn("score", trees.probability(df.sparkSession, model, kind == "gbt", columns))
            parts.append(scored.select(F.lit(n // folds + 1).alias("candidate"), "fold", "label", "score", F.lit(1).alias("count")))
        scored = functools.reduce(DataFrame.unionByName, parts)
    else:
        scored = trees.left_out_scores(blocks, edges, models, folds, kind == "gbt")
    found: dict[int, list[float]] = {}
    for r in ranking_scores(scored, "label", "score", ["candidate", "fold"], "count").select("candidate", "fold", "pr_auc").collect():
        found.setdefault(r.candidate, []).append(r.pr_auc)
    results = [(c, float(np.mean(v)), float(np.std(v)), json.dumps(given[c - 1], sort_keys=True)) for c, v in found.items()]
    results.sort(key=lambda r: (-r[1], r[0]))
    schema = "candidate int, mean_average_precision double, std_average_precision double, parameters string"
    return json.loads(results[0][3]), local_table(df.sparkSession, results, schema)
