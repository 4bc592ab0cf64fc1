"""Scoring plans: flow exports, plain tables and batches of files."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.expr import INVALID_INPUT, SCORED, all_present, decide, finite, quoted
from flowspark.operators.models import attack_probability
from flowspark.operators.scale import apply_scaler
from flowspark.plans.artifact import Artifact
from flowspark.sources.files import RANGE_ROWS, StagedOutput, refuse_existing, save_data, stem, write_text
from flowspark.sources.flowcsv import coerce_features, number_rows, read_flows

Scorer = Callable[[DataFrame], DataFrame]

WHOLE = "__whole"  # are all features of a row there?

RESULT_COLUMNS = (
    "source_row", "model_version", "threshold", "prediction", "probability", "is_alert", "score_status",
)


def artifact_scorer(artifact: Artifact) -> Scorer:
    """Scaling and model of an artifact as one lazy step that adds ``probability``."""
    return lambda df: attack_probability(apply_scaler(df, artifact.scaler), artifact.model)


def expression_scorer(expression: Column | str) -> Scorer:
    """A score that is a plain expression (a Column or SQL text) over the features."""
    return lambda df: df.withColumn("probability", F.expr(expression) if isinstance(expression, str) else expression)


def score_rows(
    df: DataFrame,
    features: Sequence[str],
    scorer: Scorer,
    threshold: float,
    version: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exactly one result row per input row, from a single pass.

    Rows with an unusable feature keep their place with an empty prediction and
    probability, no alert and the status ``invalid_input``.
    """
    typed = coerce_features(df, features)
    scored = scorer(typed)
    valid = F.col("_valid") & F.col("probability").isNotNull()
    probability = F.when(valid, F.col("probability"))
    return scored.select(
        *[quoted(k) for k in keep],
        F.lit(version).alias("model_version"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(valid, decide(probability, threshold)).cast("int").alias("prediction"),
        probability.alias("probability"),
        F.coalesce(valid & (decide(probability, threshold) == 1), F.lit(False)).alias("is_alert"),
        F.when(valid, SCORED).otherwise(INVALID_INPUT).alias("score_status"),
    )


def _row_counts() -> list[Column]:
    return [
        F.count("*").alias("rows_read"),
        F.count(F.when(F.col("score_status") == SCORED, 1)).alias("rows_scored"),
        F.count(F.when(F.col("score_status") == INVALID_INPUT, 1)).alias("rows_invalid_input"),
        F.count(F.when(F.col("is_alert"), 1)).alias("alerts"),
    ]


def ingest_counts(results: DataFrame) -> DataFrame:
    """Rows read, scored and invalid, alerts, and the number of (version, threshold) pairs."""
    return results.agg(*_row_counts(), F.count_distinct("model_version", "threshold").alias("operating_points"))


def score_flow_files(
    spark: SparkSession,
    paths: Sequence[str],
    output: str,
    features: Sequence[str],
    scorer: Scorer,
    threshold: float,
    version: str,
    *,
    format: str = "csv",
    ordered: bool = True,
    overwrite: bool = False,
) -> dict:
    """Score exports into one published table with a manifest beside it.

    The rows are counted as the writing tasks see them, so nothing is read again; a failure leaves an earlier output
    as it was.
    """
    refuse_existing(spark, [output], overwrite)
    flows = number_rows(read_flows(spark, list(paths), features))
    results = score_rows(flows, features, scorer, threshold, version, ["source_file", "source_row"])
    if ordered:
        order = ["source_file", "source_row"]
        # Tasks sort a bounded number of rows each, however large the exports are.
        ranges = max(1, -(-flows.count() // RANGE_ROWS))
        results = results.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    seen = Observation("ingested")
    point = F.struct("model_version", "threshold")
    observed = results.observe(seen, *_row_counts(), F.min(point).alias("lowest"), F.max(point).alias("highest"))
    with StagedOutput(spark, output) as staging:
        writer = observed.write.format(format)
        (writer.option("header", True) if format == "csv" else writer).save(staging)
        counts = dict(seen.get)
        if not counts["rows_read"]:
            raise ValueError("The exports hold no flow records")
        if counts.pop("lowest") != counts.pop("highest"):
            raise RuntimeError("The output would mix operating points; it is not published.")
    manifest = {
        "input_paths": list(paths),
        "output_path": output,
        "model_version": version,
        "threshold": threshold,
        "required_features": list(features),
        **counts,
    }
    write_text(spark, output.rstrip("/") + ".manifest.json", json.dumps(manifest, indent=2))
    return manifest


def predict_table(df: DataFrame, artifact: Artifact, probabilities: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """``prediction`` and optional ``probability`` per row; extra columns are ignored.

    A row with a missing or non-finite feature fails the job that scores it, without a pass of its own over
    the input.
    """
    missing = [f for f in artifact.features if f not in df.columns]
    if missing:
        raise ValueError(f"The table is missing required features of the model: {missing}")
    needed = df.select(*[quoted(c) for c in dict.fromkeys([*keep, *artifact.features])])
    whole = all_present([finite(quoted(f).cast("double")) for f in artifact.features])
    refusal = F.raise_error(F.lit("A row to predict has missing or infinite features.")).cast("double")
    marked = artifact_scorer(artifact)(needed.withColumn(WHOLE, whole))
    scored = marked.withColumn("probability", F.when(F.col(WHOLE), F.col("probability")).otherwise(refusal)).withColumn(
        "prediction", decide(F.col("probability"), artifact.threshold)
    )
    return scored.select(*[quoted(k) for k in keep], "prediction", *(["probability"] if probabilities else []))


def predict_file(
    spark: SparkSession, artifact: Artifact, path: str, output: str | None = None, format: str = "csv"
) -> DataFrame:
    """Score one table and optionally save the result."""
    from flowspark.sources.files import load_data

    results = predict_table(load_data(spark, path), artifact)
    if output:
        save_data(results, output, format)
    return results


def batch_predict(spark: SparkSession, artifact: Artifact, paths: Sequence[str], output: str | None = None) -> DataFrame:
    """Score many exports in one scan; the sink has one folder per input file."""
    flows = read_flows(spark, list(paths), artifact.features)
    results = score_rows(
        flows, artifact.features, artifact_scorer(artifact), artifact.threshold, artifact.version, ["source_file"]
    ).withColumn("input", F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", ""))
    if output:
        if len({stem(p) for p in paths}) != len(paths):
            raise ValueError("Input files must have different names to be written side by side.")
        save_data(results.drop("source_file"), output, "parquet", partition_by=["input"])
    return results
