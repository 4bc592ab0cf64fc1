"""Label rules and the two-class contract (0 = benign, 1 = attack)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import quoted, strip

LABEL = "label"


def substring_label(text: Column) -> Column:
    """0 when the text mentions benign in any case, else 1; a missing text is 1."""
    return F.when(F.lower(text.cast("string")).contains("benign"), 0).otherwise(1)


def exact_label(text: Column) -> Column:
    """0 only for the stripped text BENIGN in capitals; NULL for a blank or missing one."""
    trimmed = strip(text.cast("string"))
    return F.when(trimmed == "BENIGN", 0).when(trimmed != "", 1)


def find_label_column(df: DataFrame, *words: str) -> str | None:
    """First column whose lowercase name contains one of the words."""
    for name in df.columns:
        if any(word in name.lower() for word in (words or (LABEL,))):
            return name
    return None


def standardize_labels(df: DataFrame) -> DataFrame:
    """Turn the first label-like column into the integer column ``label``."""
    source = find_label_column(df)
    if source is None:
        return df
    return df.withColumn(source, substring_label(quoted(source))).withColumnRenamed(source, LABEL)


def external_label_column(columns: list[str]) -> str:
    found = [c for c in columns if c.lower() == LABEL]
    if len(found) != 1:
        raise ValueError("One label column is needed in external data, neither none nor several.")
    return found[0]


def label_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: which of the contract's values occur and whether it holds.

    The flags are conditional aggregates, so labels outside the contract cost
    nothing however many different ones there are.
    """
    value = quoted(label)
    zero = F.coalesce(F.max(F.when(value == 0, True).otherwise(False)), F.lit(False))
    one = F.coalesce(F.max(F.when(value == 1, True).otherwise(False)), F.lit(False))
    other = F.count(F.when(value.isNotNull() & ~value.isin(0, 1), 1))
    missing = F.count(F.when(value.isNull(), 1))
    return df.agg(
        zero.alias("has_benign"),
        one.alias("has_attack"),
        other.alias("other_rows"),
        missing.alias("missing_rows"),
    ).withColumn("contract_holds", F.col("has_benign") & F.col("has_attack") & (F.col("other_rows") == 0))


def check_labels(df: DataFrame, label: str = LABEL, allow_missing: bool = False) -> None:
    """Raise unless the labels are exactly 0 and 1.

    Training ignores missing labels; release validation does not.
    """
    if label not in df.columns:
        raise ValueError(f"There is no label column {label!r}.")
    row = label_summary(df, label).first()
    if not row["contract_holds"] or (row["missing_rows"] and not allow_missing):
        raise ValueError("Labels must be encoded exactly as 0 (benign) and 1 (attack).")


def check_trainable(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Class counts of a training table; a single class is refused with its distribution."""
    value = quoted(label).try_cast("double")
    other = quoted(label).isNotNull() & ~F.coalesce(value.isin(0.0, 1.0), F.lit(False))
    row = df.agg(*[F.count(F.when(c, 1)) for c in (value == 0, value == 1, other)]).first()
    counts = {k: n for k, n in zip((0, 1, "other"), row) if n}
    if len(counts) < 2:
        raise ValueError(f"A classifier needs rows of both classes; what is left has {counts}.")
    check_labels(df, label, allow_missing=True)
    return counts


def single_source(df: DataFrame) -> DataFrame:
    """Accept a standardised table only when both classes occur."""
    if LABEL not in df.columns:
        raise ValueError("A single source needs the column 'label'.")
    row = label_summary(df).first()
    if not (row["has_benign"] and row["has_attack"]) or row["other_rows"]:
        raise ValueError("A single source needs benign rows and attacks.")
    return df
