"""Dataset manifests, content fingerprints and the release quality gate."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.expr import quoted
from flowspark.operators.labels import LABEL
from flowspark.session import collect_bounded, local_table

GATE_SCHEMA = "rule string, observed double, required double, passed boolean"


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content fingerprint: row count, hash sum and hash xor.

    A sequential file hash would force one reader over all bytes; a sum and an xor
    of row hashes combine across partitions in any order.
    """
    digest = F.xxhash64(*[quoted(c) for c in df.columns])
    return df.select(digest.alias("h")).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"),
    )


def schema_hash(df: DataFrame) -> str:
    described = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    return hashlib.sha256(described.encode("utf-8")).hexdigest()


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label value, the missing label included."""
    return df.groupBy(quoted(label).cast("string").alias("label")).agg(F.count("*").alias("rows"))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Number and total size of the files under a path; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select("length").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def dataset_manifest(df: DataFrame, path: str | None = None, label: str = LABEL) -> dict:
    """Counts, schema and content identity of a table as plain values."""
    content = fingerprint(df).first()
    manifest = {
        "path": path,
        "rows": content["rows"],
        "columns": df.columns,
        "schema_sha256": schema_hash(df),
        "content": {"hash_sum": content["hash_sum"], "hash_xor": content["hash_xor"]},
        "label_column": label if label in df.columns else None,
    }
    if path is not None:
        manifest["bytes"] = file_bytes(df.sparkSession, path).first()["bytes"]
    if label in df.columns:
        rows = collect_bounded(label_counts(df, label), "Label counts")
        manifest["label_counts"] = {str(r["label"]): r["rows"] for r in sorted(rows, key=lambda r: str(r["label"]))}
    return manifest


def quality_gate(
    validation: DataFrame, test: DataFrame, min_recall: float, max_fpr: float, threshold: float, candidates: Sequence[float],
    complied: bool | None = None,
) -> DataFrame:
    """One row per release rule with what was seen, what is asked for and the verdict.

    ``validation`` and ``test`` are one-row metric tables with ``recall`` and ``fpr``; a missing one does not pass.
    ``complied`` says whether the threshold kept to the policy when it was chosen on the validation part, which then
    is a rule as well.
    """

    def limits(metrics: DataFrame, part: str) -> DataFrame:
        recall, fpr = F.col("recall"), F.col("fpr")
        rules = F.array(
            F.struct(
                F.lit(f"{part}_recall").alias("rule"), recall.alias("observed"),
                F.lit(float(min_recall)).alias("required"), F.coalesce(recall >= min_recall, F.lit(False)).alias("passed"),
            ),
            F.struct(
                F.lit(f"{part}_fpr").alias("rule"), fpr.alias("observed"),
                F.lit(float(max_fpr)).alias("required"), F.coalesce(fpr <= max_fpr, F.lit(False)).alias("passed"),
            ),
        )
        return metrics.select(F.explode(rules).alias("r")).select("r.*")

    known = any(float(threshold) == float(c) for c in candidates)
    chosen = [("threshold_is_candidate", float(threshold), None, known)]
    if complied is not None:
        chosen.append(("validation_choice_complied", float(complied), 1.0, bool(complied)))
    listed = local_table(validation.sparkSession, chosen, GATE_SCHEMA)
    return limits(validation, "validation").unionByName(limits(test, "test")).unionByName(listed)


def valid_model_hash(text: str | None) -> bool:
    """64 hexadecimal digits."""
    return isinstance(text, str) and re.fullmatch("[0-9A-Fa-f]{64}", text) is not None


def require_gate(gate: DataFrame, model_hash: str | None) -> dict:
    """Raise with every failed rule at once; return the report otherwise."""
    rows = gate.collect()
    failures = [
        f"{r['rule']} is " + ("missing" if r["observed"] is None else f"{r['observed']:.6f}")
        + (f", required {r['required']:.6f}" if r["required"] is not None else "")
        for r in rows
        if not r["passed"]
    ]
    if not valid_model_hash(model_hash):
        failures.append("model hash is not a 64-character hexadecimal SHA-256")
    if failures:
        raise ValueError("The release does not pass: " + "; ".join(failures))
    return {"passed": True, "rules": [r.asDict() for r in rows]}
