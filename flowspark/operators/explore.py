"""Table profiles: columns, numeric statistics, labels, files, gaps and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import edges_passed, long_form, quoted
from flowspark.functions.quantiles import column_quantiles
from flowspark.operators.clean import numeric_columns, wide_aggregate
from flowspark.operators.labels import find_label_column
from flowspark.session import local_table

HISTOGRAM_BINS = 30


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one.  Equal rows combine before the shuffle."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for every column."""
    found = wide_aggregate(df, {(c,): F.count(F.when(quoted(c).isNull(), 1)) for c in df.columns})
    return local_table(df.sparkSession, [(c, found[c,]) for c in df.columns], "column string, missing bigint")


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and duplicate rows."""
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.when(quoted(c).isNull(), 1).otherwise(0)
    sizes = df.select(cells.cast("bigint").alias("_gaps")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("_gaps"), F.lit(0)).alias("missing_cells")
    )
    row, copies = sizes.first(), duplicate_rows(df).first()
    return local_table(
        df.sparkSession,
        [(row["rows"], len(df.columns), row["missing_cells"], copies["duplicates"])],
        "rows bigint, columns int, missing_cells bigint, duplicates bigint",
    )


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, present values and distinct values per column.

    Distinct counts go through one long-form aggregate, so all columns share a
    shuffle of distinct (column, value) pairs; the sketch needs no such shuffle.
    """
    if approximate:
        made = {}
        for c in df.columns:
            made[c, "n"] = F.count(quoted(c))
            made[c, "u"] = F.approx_count_distinct(quoted(c))
        found = wide_aggregate(df, made)
        rows = [(c, df.schema[c].dataType.simpleString(), found[c, "n"], found[c, "u"]) for c in df.columns]
        return local_table(df.sparkSession, rows, "column string, type string, non_null bigint, unique bigint")
    text = df.select(*[quoted(c).cast("string").alias(c) for c in df.columns])
    pairs = text.unpivot([], [quoted(c) for c in df.columns], "column", "value").where("value IS NOT NULL")
    distinct = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    counted = distinct.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("unique"))
    types = local_table(
        df.sparkSession, [(c, df.schema[c].dataType.simpleString()) for c in df.columns], "column string, type string"
    )
    return types.join(counted, "column", "left").na.fill(0)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    chosen = list(columns or numeric_columns(df))
    long = long_form(df, chosen)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    found = column_quantiles(df, chosen, [0.25, 0.5, 0.75])
    quartiles = local_table(
        df.sparkSession,
        [(c, v[0.25], v[0.5], v[0.75]) for c, v in found.items()],
        "feature string, q1 double, median double, q3 double",
    )
    return basic.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q1", "median", "q3", "max"
    )


def feature_summary(df: DataFrame) -> DataFrame:
    """One row: features, samples, missing cells and columns per type class."""
    overall = profile_without_duplicates(df)
    numeric = len(numeric_columns(df))
    return overall.withColumns(
        {"numeric_columns": F.lit(numeric), "other_columns": F.lit(len(df.columns) - numeric)}
    )


def profile_without_duplicates(df: DataFrame) -> DataFrame:
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.when(quoted(c).isNull(), 1).otherwise(0)
    return df.select(cells.cast("bigint").alias("_gaps")).agg(
        F.lit(len(df.columns)).alias("features"),
        F.count("*").alias("samples"),
        F.coalesce(F.sum("_gaps"), F.lit(0)).alias("missing_cells"),
    )


def label_distribution(df: DataFrame, label: str | None = None) -> DataFrame:
    """(label, rows, percent) of the first label- or class-like column.

    Percentages refer to all rows, so missing labels lower the sum.
    """
    column = label or find_label_column(df, "label", "class")
    if column is None:
        raise ValueError("There is no label or class column.")
    counted = df.groupBy(quoted(column).cast("string").alias("label")).agg(F.count("*").alias("rows"))
    total = counted.agg(F.sum("rows").alias("t")).first()["t"] or 0
    return (
        counted.where("label IS NOT NULL")
        .withColumn("percent", F.col("rows").cast("double") / F.lit(float(max(total, 1))) * 100)
        .orderBy(F.desc("rows"), "label")
    )


def source_summary(df: DataFrame, source: str, label: str) -> DataFrame:
    """Rows and most frequent label per source plus the grand total.

    The label counts combine first, so the rollup and the choice of the top label
    work on one record per (source, label).
    """
    counts = df.groupBy(quoted(source).alias("source"), quoted(label).cast("string").alias("label")).agg(
        F.count("*").alias("n")
    )
    totals = counts.rollup("source").agg(
        F.sum("n").alias("rows"),
        F.max_by("label", F.struct(F.when(F.col("label").isNull(), 0).otherwise(F.col("n")), F.col("label"))).alias("top"),
        F.grouping("source").alias("is_total"),
    )
    return totals.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("source")).alias("source"),
        "rows",
        F.when(F.col("is_total") == 0, F.col("top")).alias("primary_label"),
    )


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def missing_top(df: DataFrame, n: int = 10) -> DataFrame:
    """Columns with the most missing values."""
    return missing_counts(df).where("missing > 0").orderBy(F.desc("missing"), "column").limit(n)


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts per column, the last bin closed; empty bins are listed too."""
    chosen = list(columns or numeric_columns(df))
    ends = wide_aggregate(
        df,
        {
            **{(c, "lo"): F.min(quoted(c).cast("double")) for c in chosen},
            **{(c, "hi"): F.max(quoted(c).cast("double")) for c in chosen},
        },
    )
    edges: dict[str, list[float]] = {}
    for c in chosen:
        low, high = ends[c, "lo"], ends[c, "hi"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        step = (high - low) / bins
        edges[c] = [low + i * step for i in range(bins)] + [high]
    coded = df.select(*[edges_passed(quoted(c).cast("double"), e[1:-1]).alias(c) for c, e in edges.items()])
    long = coded.unpivot([], [quoted(c) for c in edges], "feature", "bin").where("bin IS NOT NULL")
    counts = long.groupBy("feature", "bin").agg(F.count("*").alias("n"))
    grid = local_table(
        df.sparkSession,
        [(c, i, e[i], e[i + 1]) for c, e in edges.items() for i in range(bins)],
        "feature string, bin int, lower double, upper double",
    )
    return grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["n"])
