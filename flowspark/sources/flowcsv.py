"""Flow exports as CSV: header contract, typed rows, row numbers, external labels."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.expr import MISSING_TEXTS, all_present, normalise_header, quoted, to_number
from flowspark.operators.governance import fingerprint
from flowspark.operators.labels import exact_label, external_label_column
from flowspark.session import collect_bounded, local_table, materialize
from flowspark.sources.files import csv_headers, list_files, plain_name, refuse_existing, save_data, write_text


def repeated_names(names: Sequence[str]) -> list[str]:
    return sorted({n for n in names if list(names).count(n) > 1})


def check_header(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Normalised names of a header, or an error naming what is wrong with it."""
    names = [normalise_header(c) for c in columns]
    if repeated_names(names):
        raise ValueError(f"Headers fall together under one name: {repeated_names(names)}")
    missing = [f for f in required if f not in names]
    if missing:
        raise ValueError("The model needs columns that the export does not have: " + ", ".join(missing))
    return names


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename the columns of a table to their normalised names."""
    names = [normalise_header(c) for c in df.columns]
    if repeated_names(names):
        raise ValueError(f"Headers fall together under one name: {repeated_names(names)}")
    return df.toDF(*names)


def present_text(cell: Column) -> Column:
    """A cell, or NULL when its text stands for a missing value (no such text is a number)."""
    return F.when(~cell.isin(*MISSING_TEXTS), cell)


def read_flows(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str], label: bool = False
) -> DataFrame:
    """Required columns of many exports as text, with file lineage.

    Files are grouped by header line, so exports with different column orders or
    older names can be read together: one scan per distinct header.  Columns are
    positional text until they are coerced, so a bad cell never fails a read.  A row with more
    fields than the header has no cell that can be trusted: all of them are NULL.
    """
    groups: dict[tuple, list[str]] = {}
    for row in collect_bounded(csv_headers(spark, paths), "File list", bound=2_000_000):
        groups.setdefault(tuple(row["columns"]), []).append(row["path"])
    combined = None
    for header, members in groups.items():
        names = check_header(header, required)
        positions = {f: names.index(f) for f in required}
        if label:
            positions["_label"] = names.index(external_label_column(names))
        # One field more takes what a row has too many.  The last one is never selected: so the reader
        # always picks fields by position and does not treat rows that lack it as malformed.
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 2)])
        fits = F.col(f"c{len(names)}").isNull()
        part = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .csv(sorted(members))
            .select(
                *[
                    F.when(fits, present_text(F.col(f"c{i}")) if f == "_label" else F.col(f"c{i}")).alias(f)
                    for f, i in positions.items()
                ],
                plain_name(F.col("_metadata.file_path")).alias("source_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_place"),
            )
        )
        combined = part if combined is None else combined.unionByName(part)
    return combined


def number_rows(flows: DataFrame) -> DataFrame:
    """Dense 0-based ``source_row`` per file.

    Rows keep their order inside a file split, so only the number of rows per
    split (a table of one record per split) has to be accumulated.
    """
    stored = materialize(flows, "flows")
    splits = stored.groupBy("source_file", "_block").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = collect_bounded(
        splits.select(
            "source_file",
            "_block",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "File splits",
        bound=2_000_000,
    )
    table = local_table(flows.sparkSession, offsets, "source_file string, _block bigint, _shift bigint")
    return (
        stored.join(table, ["source_file", "_block"])
        .withColumn("source_row", F.col("_place") + F.col("_shift"))
        .drop("_block", "_place", "_shift")
    )


def coerce_features(df: DataFrame, features: Sequence[str], valid: str = "_valid") -> DataFrame:
    """Features as finite DOUBLE or NULL, plus a flag for complete rows."""
    typed = df.withColumns(
        {
            f: to_number(quoted(f))
            if isinstance(df.schema[f].dataType, T.StringType)
            else to_number(quoted(f).cast("string"))
            for f in features
        }
    )
    return typed.withColumn(valid, all_present([quoted(f) for f in features]))


def prepare_external(flows: DataFrame, features: Sequence[str], label: str = "_label") -> tuple[DataFrame, DataFrame]:
    """Complete labelled rows of an external dataset, and the counts of the run.

    Nothing is fitted and no model is involved: headers, numbers and labels only.
    """
    typed = coerce_features(flows, features).withColumn("label", exact_label(quoted(label)))
    kept = F.col("_valid") & F.col("label").isNotNull()
    counts = typed.agg(
        F.count(F.when(kept, 1)).alias("rows_written"),
        F.count(F.when(~kept, 1)).alias("rows_dropped"),
        F.count(F.when(kept & (F.col("label") == 0), 1)).alias("benign"),
        F.count(F.when(kept & (F.col("label") == 1), 1)).alias("attack"),
    )
    return typed.where(kept).select(*[quoted(f) for f in features], "label"), counts


def prepare_external_folder(
    spark: SparkSession, folder: str, features: Sequence[str], output: str, format: str = "csv"
) -> dict:
    """Standardise every CSV of a folder into one labelled table, published at once."""
    if not features:
        raise ValueError("The features to prepare external data for must be named.")
    files = [p for p, _, _ in list_files(spark, folder, ".csv")]
    if not files:
        raise FileNotFoundError(f"The folder {folder} holds no CSV file.")
    refuse_existing(spark, [output])
    stored = materialize(read_flows(spark, files, features, label=True), "external")
    prepared, counts = prepare_external(stored, features)
    totals = counts.first().asDict()
    if not totals["rows_written"]:
        raise ValueError("Not one row of the external data has a label and all features.")
    save_data(prepared, output, format)
    manifest = {
        "source_files": files,
        "fixed_features": list(features),
        "output_path": output,
        "rows_written": totals["rows_written"],
        "rows_dropped_nonfinite_or_unlabeled": totals["rows_dropped"],
        "label_counts": {"benign": totals["benign"], "attack": totals["attack"]},
        "output_fingerprint": {k: str(v) for k, v in fingerprint(prepared).first().asDict().items()},
    }
    write_text(spark, output.rstrip("/") + ".manifest.json", json.dumps(manifest, indent=2))
    return manifest
