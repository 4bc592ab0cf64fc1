"""Train, validate and report: every learned step sees training rows only."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.expr import decide, quoted
from flowspark.operators.clean import clean_holdout, clean_training, numeric_columns
from flowspark.operators.drift import calibration_summary, calibration_table, drift_baseline, drift_report
from flowspark.operators.governance import dataset_manifest
from flowspark.operators.labels import check_labels, standardize_labels
from flowspark.operators.labels import single_source as check_single_source
from flowspark.operators.metrics import (
    MAX_FPR, MIN_RECALL, THRESHOLD_CANDIDATES, all_compliant, binary_metrics, error_summary, evaluate,
    fold_summary, policy_flags, ranking_scores, select_threshold, with_outcome,
)
from flowspark.operators.models import attack_probability, feature_importance, resolve_parameters, train
from flowspark.operators.scale import apply_scaler, fit_scaler, validate_features
from flowspark.operators.selection import FeaturePlan, apply_features, fit_features, importance_stability
from flowspark.operators.split import inner_split, stratified_folds, stratified_split
from flowspark.plans.artifact import Artifact, model_hash, save_artifact
from flowspark.session import discard, local_table, localise, materialize
from flowspark.sources.files import StagedOutput, refuse_existing, save_data, union_files, write_text


CONCURRENT_FOLDS = 5
ROWS_AT_ONCE = 25_000_000  # of all folds that run beside one another: what they write and shuffle is on disk at once


@dataclass(frozen=True)
class Settings:
    """Choices of a run; nothing here is learned."""

    kind: str = "gbt"
    parameters: Mapping = field(default_factory=dict)
    train: float = 0.7
    test: float = 0.15
    val: float = 0.15
    seed: int = 42
    deduplicate: bool = True
    missing: str = "drop"
    outliers: str | None = None
    drop_constant: bool = True
    remove_correlated: bool = True
    correlation_threshold: float = 0.95
    n_features: int | None = 20
    selection: str = "f_classif"
    fixed_features: Sequence[str] | None = None
    scaling: str = "minmax"
    candidates: Sequence[float] = THRESHOLD_CANDIDATES
    min_recall: float = MIN_RECALL
    max_fpr: float = MAX_FPR
    frozen_threshold: float | None = None
    default_threshold: float = 0.5


@dataclass
class Fitted:
    """Result of fitting on one training part."""

    plan: FeaturePlan
    artifact: Artifact
    prepare: Callable[[DataFrame], DataFrame]
    threshold_table: DataFrame
    scored_validation: DataFrame


def fit_parts(
    training: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    settings: Settings,
    version: str,
    with_baseline: bool = True,
) -> Fitted:
    """Clean, select, scale and train on ``training``; choose the threshold on ``validation``."""
    order = [row_id]
    cleaned, cleaning = clean_training(
        training.select(quoted(row_id), *[quoted(f) for f in features], quoted(label).alias("label")),
        features,
        "label",
        deduplicate=settings.deduplicate,
        strategy=settings.missing,
        outliers=settings.outliers,
        drop_constant=settings.drop_constant,
        order_by=order,
    )
    plan = fit_features(
        cleaned,
        cleaning.features,
        "label",
        remove_correlated=settings.remove_correlated,
        correlation_threshold=settings.correlation_threshold,
        n_features=settings.n_features,
        method=settings.selection,
        fixed=settings.fixed_features,
    )
    # Distribution of the raw values, before scaling hides it.
    selected = materialize(apply_features(cleaned, plan, ["label"]), "train_features")
    discard(cleaned)
    baseline = drift_baseline(selected, plan.selected) if with_baseline else None
    scaler = fit_scaler(selected, plan.selected, settings.scaling)
    model = train(apply_scaler(selected, scaler), plan.selected, settings.kind, settings.parameters)
    if not with_baseline:  # a baseline reads them later
        discard(selected)

    def prepare(part: DataFrame) -> DataFrame:
        """Held-out rows cleaned, projected, scaled and scored with what was learned."""
        kept = clean_holdout(
            part.select(quoted(row_id), *[quoted(f) for f in features], quoted(label).alias("label")),
            cleaning,
            features,
            [row_id, "label"],
            order,
        )
        return attack_probability(apply_scaler(apply_features(kept, plan, [row_id, "label"]), scaler), model)

    scored = materialize(prepare(validation).select(row_id, "label", "probability"), "validation_scores")
    threshold, table = select_threshold(
        scored, "label", "probability", settings.candidates, settings.min_recall, settings.max_fpr,
        settings.frozen_threshold,
    )
    artifact = Artifact(
        model=model,
        scaler=scaler,
        features=tuple(plan.selected),
        threshold=threshold,
        version=version,
        policy={"min_recall": settings.min_recall, "max_fpr": settings.max_fpr, "candidates": list(settings.candidates)},
        baseline=baseline,
    )
    return Fitted(plan, artifact, prepare, table, scored)


def train_pipeline(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    settings: Settings = Settings(),
    version: str = "model",
    output: str | None = None,
    overwrite: bool = False,
) -> tuple[Artifact, dict[str, DataFrame]]:
    """The whole run: split, fit, choose the threshold, judge once on the test part.

    The splits are saved unscaled together with the scaler, so a saved split can be
    used with any later model.
    """
    spark = df.sparkSession
    if output:
        refuse_existing(spark, [output], overwrite)
    check_labels(df, label, allow_missing=True)
    parts = stratified_split(
        df, label, row_id, settings.train, settings.test, settings.val, settings.seed, name="_split"
    )
    fitted = fit_parts(
        parts.where("_split = 'train'"), parts.where("_split = 'val'"), features, label, row_id, settings, version
    )
    chosen = fitted.threshold_table.where(F.col("threshold") == fitted.artifact.threshold).first()
    fitted.artifact.run = {
        "rows": {r["_split"]: r["count"] for r in parts.groupBy("_split").count().collect()},
        "parameters": resolve_parameters(settings.kind, settings.parameters),
        "seed": settings.seed,
        "scaling": settings.scaling,
        # A frozen threshold need not be among the candidates, and then nothing was seen of it.
        "validation": None if chosen is None else {"recall": chosen["recall"], "fpr": chosen["fpr"], "complied": chosen["meets_targets"]},
    }
    tested = materialize(
        fitted.prepare(parts.where("_split = 'test'"))
        .select(row_id, "label", "probability")
        .withColumn("prediction", decide(F.col("probability"), fitted.artifact.threshold)),
        "test_scores",
    )
    reports = evaluate(tested, "label", "prediction", [0, 1], "probability")
    reports["threshold_selection"] = fitted.threshold_table
    reports["calibration"] = calibration_table(fitted.scored_validation, "label", "probability")
    reports["calibration_summary"] = calibration_summary(fitted.scored_validation, "label", "probability")
    if output:
        kept = [quoted(row_id), *[quoted(f) for f in features], quoted(label).alias("label")]
        splits = {f"split_{p}": parts.where(F.col("_split") == p).select(*kept) for p in ("train", "val", "test")}
        save_artifact(spark, fitted.artifact, output, {**splits, **reports}, overwrite)
    return fitted.artifact, reports


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    settings: Settings = Settings(),
    folds: int = 5,
) -> dict[str, DataFrame]:
    """Nested cross-validation: all learning inside each outer training part.

    Both operating points are reported per fold: the one chosen on the inner
    validation part and the frozen default.
    """
    check_labels(df, label)
    needed = df.select(*[quoted(c) for c in dict.fromkeys([row_id, label, *features])])
    folded = materialize(stratified_folds(needed, label, row_id, folds, settings.seed), "folds")
    frozen = settings.frozen_threshold or settings.default_threshold

    @inheritable_thread_target(df.sparkSession)
    def one_fold(fold: int) -> tuple[DataFrame, DataFrame | None]:
        inner = inner_split(folded, label, row_id, fold, settings.train, settings.val, settings.seed, "_split")
        fitted = fit_parts(
            inner.where("_split = 'train'"), inner.where("_split = 'val'"), features, label, row_id, settings,
            f"fold_{fold}", with_baseline=False,
        )
        outer = fitted.prepare(folded.where(F.col("fold") == fold)).select(
            row_id, "label", "probability", F.lit(fold).alias("fold"), F.lit(fitted.artifact.threshold).alias("threshold")
        )
        own = feature_importance(df, fitted.artifact.model).withColumn("fold", F.lit(fold)) if fitted.artifact.model.has_importances else None
        return materialize(outer, "outer_scores"), own

    # A small fold's jobs are many and short, so folds run beside one another on the same executors.  A large fold's tasks
    # fill them alone, and its files are gone before the next begins.
    beside = min(folds, CONCURRENT_FOLDS, max(1, ROWS_AT_ONCE // max(1, folded.count())))
    with ThreadPoolExecutor(beside) as pool:
        done = list(pool.map(one_fold, range(1, folds + 1)))
    discard(folded)
    scores, importances = [s for s, _ in done], [i for _, i in done if i is not None]

    def stack(tables):
        combined = tables[0]
        for table in tables[1:]:
            combined = combined.unionByName(table)
        return combined

    # All folds are judged together, one group per fold; ranking does not depend on a threshold.
    out_of_fold = stack(scores)
    ranking = localise(ranking_scores(out_of_fold, "label", "probability", ["fold"]), "fold_ranking")

    def judged(threshold) -> DataFrame:
        decided_rows = out_of_fold.withColumns(
            {"threshold": threshold, "prediction": F.when(F.col("probability") >= threshold, 1).otherwise(0)}
        )
        metrics = binary_metrics(decided_rows, "label", "prediction", keys=["fold", "threshold"]).join(ranking, "fold")
        return localise(policy_flags(metrics, settings.min_recall, settings.max_fpr), "fold_metrics")

    selected = judged(F.col("threshold"))
    fixed = judged(F.lit(float(frozen)))
    diagnosed = with_outcome(
        out_of_fold.withColumn("predicted_label", decide(F.col("probability"), frozen)),
        "label", "predicted_label", "probability", frozen,
    )
    report = {
        "fold_metrics": selected,
        "summary": fold_summary(selected),
        "fixed_threshold_fold_metrics": fixed,
        "fixed_threshold_summary": fold_summary(fixed),
        "policy": all_compliant(fixed),
        "out_of_fold_predictions": diagnosed.select(
            F.col(row_id).alias("source_row_id"),
            F.col("label").alias("actual_label"),
            "predicted_label",
            F.col("probability").alias("attack_probability"),
            "distance_from_threshold",
            "outcome",
            "fold",
        ),
        "error_summary": error_summary(diagnosed, "probability"),
    }
    if importances:
        by_fold = stack(importances)
        report["feature_importance_by_fold"] = by_fold
        report["feature_importance_summary"] = importance_stability(by_fold, folds)
    return report



def create_holdout(
    df: DataFrame, label: str, row_id: str, output: str, size: float = 0.15, seed: int = 42, overwrite: bool = False
) -> dict:
    """Split once into development and final holdout, written side by side with a manifest."""
    if not 0.0 < size < 1.0:
        raise ValueError("The holdout must be a share between 0 and 1.")
    check_labels(df, label)
    spark = df.sparkSession
    refuse_existing(spark, [output], overwrite)
    parts = stratified_split(df, label, row_id, 1.0 - size, size, 0.0, seed, name="_split")
    with StagedOutput(spark, output) as staging:
        manifest = {"label_contract": {"0": "benign", "1": "attack"}, "holdout_size": size, "seed": seed}
        for name, value in (("development", "train"), ("final_holdout", "test")):
            parts.where(F.col("_split") == value).drop("_split").write.parquet(f"{staging}/{name}")
            written = spark.read.parquet(f"{staging}/{name}")
            manifest[name] = dataset_manifest(written, None, label)
            manifest[f"{name}_rows"] = manifest[name]["rows"]
        write_text(spark, f"{staging}/manifest.json", json.dumps(manifest, indent=2, default=str))
    return manifest


def evaluate_frozen(
    df: DataFrame, artifact: Artifact, label: str = "label", expected_threshold: float | None = None,
    psi_alert: float = 0.2,
) -> dict[str, DataFrame]:
    """Judge a frozen artifact on independent labelled rows; nothing is tuned.

    ``identity`` tells which model was judged on which rows.
    Missing or non-finite features are refused: no model output would mean anything for such rows.
    """
    if expected_threshold is not None and expected_threshold != artifact.threshold:
        raise ValueError("The run was saved with another threshold than the one expected.")
    check_labels(df, label)
    needed = df.select(*[quoted(f) for f in artifact.features], quoted(label).alias("label"))
    validate_features(needed, artifact.features)
    scored = attack_probability(apply_scaler(needed, artifact.scaler), artifact.model).withColumn(
        "prediction", decide(F.col("probability"), artifact.threshold)
    )
    judged = materialize(scored.select("label", "prediction", "probability"), "frozen_scores")
    report = evaluate(judged, "label", "prediction", [0, 1], "probability")
    report["calibration"] = calibration_table(judged, "label", "probability")
    report["calibration_summary"] = calibration_summary(judged, "label", "probability")
    if artifact.baseline is not None:
        report["drift"] = drift_report(needed, artifact.baseline, psi_alert)
    seen = dataset_manifest(needed, None, "label")
    identity = (artifact.version, model_hash(artifact.model), artifact.threshold, seen["rows"], seen["schema_sha256"], json.dumps(seen["content"]), json.dumps(seen["label_counts"]))
    report["identity"] = local_table(
        df.sparkSession, [identity], "model_version string, model_sha256 string, threshold double, rows bigint, schema_sha256 string, content string, label_counts string"
    )
    return report


def prepare_for_training(
    df: DataFrame, label: str, row_id: str, features: Sequence[str], test: float = 0.2, normalize: bool = True, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split, then clean on the training rows only; outliers stay, they may be attacks."""
    if not 0 < test < 1:
        raise ValueError("The test part must be a share between 0 and 1.")
    parts = stratified_split(df, label, row_id, 1.0 - test, test, 0.0, seed, name="_split")
    renamed = parts.withColumnRenamed(label, "label") if label != "label" else parts
    training, cleaning = clean_training(
        renamed.where("_split = 'train'"), features, "label", outliers=None, order_by=[row_id]
    )
    testing = clean_holdout(renamed.where("_split = 'test'"), cleaning, features, [row_id, "label"])
    if normalize:
        scaler = fit_scaler(training, cleaning.features, "minmax")
        training, testing = apply_scaler(training, scaler), apply_scaler(testing, scaler)
    columns = [row_id, *cleaning.features, "label"]
    return training.select(*[quoted(c) for c in columns]), testing.select(*[quoted(c) for c in columns])


def process_folder(
    spark: SparkSession,
    folder: str,
    output: str,
    features: Sequence[str] | None = None,
    test: float = 0.2,
    normalize: bool = True,
    single_source: bool = False,
    overwrite: bool = False,
) -> list[str]:
    """All Parquet files of a folder as training data.

    ``single_source`` writes one labelled table with nothing learned from it, for
    holdout creation later; otherwise a cleaned, scaled train / test pair.
    """
    combined = standardize_labels(union_files(spark, folder, place_column=None if single_source else "row_id"))
    if single_source:
        return [save_data(check_single_source(combined), f"{output}/labeled", "parquet", overwrite)]
    targets = [f"{output}/train_data", f"{output}/test_data"]
    refuse_existing(spark, targets, overwrite)
    chosen = list(features or numeric_columns(combined, ["label"]))
    parts = prepare_for_training(materialize(combined, "combined"), "label", "row_id", chosen, test, normalize)
    return [save_data(part, target, "parquet", overwrite) for part, target in zip(parts, targets)]


def save_reports(reports: Mapping[str, DataFrame], output: str, format: str = "csv", overwrite: bool = False) -> str:
    """Write every report table of a run into its own folder, published together."""
    spark = next(iter(reports.values())).sparkSession
    refuse_existing(spark, [output], overwrite)
    with StagedOutput(spark, output) as staging:
        for name, table in reports.items():
            writer = table.write.format(format)
            (writer.option("header", True) if format == "csv" else writer).save(f"{staging}/{name}")
    return output
