"""Column expressions shared by the operators.  Nothing here runs a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names of older flow exports and their current names.
HEADER_ALIASES = {
    "Total Length of Fwd Packets": "Fwd Packets Length Total",
    "min_seg_size_forward": "Fwd Seg Size Min",
    "Init_Win_bytes_forward": "Init Fwd Win Bytes",
    "Init_Win_bytes_backward": "Init Bwd Win Bytes",
    "Max Packet Length": "Packet Length Max",
    "Min Packet Length": "Packet Length Min",
}

# Cell texts that mean a missing value in a flow export.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

DECIMAL_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"

# Result states of the scoring paths.
SCORED = "scored"
INVALID_INPUT = "invalid_input"


def quoted(name: str) -> Column:
    """Column by its literal name; flow headers hold spaces, dots and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def finite(value: Column) -> Column:
    """Infinities and NaN become NULL, the one missing value used everywhere.

    The difference of a number with itself is zero unless it is not finite, then it
    is NaN.  Plain arithmetic lets generated code evaluate ``value`` once.
    """
    return F.nanvl((value - value) + value, F.lit(None).cast("double"))


def parse_number(text: Column) -> Column:
    """The decimal number a text spells, else NULL; too large a number is infinite.

    The pattern keeps out what only the JVM parser takes for a number: suffixes
    ("1d"), hexadecimal floats and the names of infinity.
    """
    return F.regexp_extract(text, DECIMAL_NUMBER, 1).try_cast("double")


def to_number(text: Column) -> Column:
    """Lenient number: whatever is not a finite decimal number becomes NULL."""
    return finite(parse_number(text))


def normalise_header(name: object) -> str:
    stripped = str(name).strip()
    return HEADER_ALIASES.get(stripped, stripped)


def all_present(columns: Iterable[Column]) -> Column:
    """True when none of the columns is NULL."""
    result = F.lit(True)
    for column in columns:
        result = result & column.isNotNull()
    return result


def decide(probability: Column, threshold: float) -> Column:
    """Alert decision at an operating threshold in (0, 1)."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("The decision threshold must lie strictly between 0 and 1.")
    return F.when(probability >= F.lit(float(threshold)), 1).otherwise(0)


def outcome(actual: Column, predicted: Column) -> Column:
    """Name of the confusion-matrix cell a row falls into."""
    return (
        F.when((actual == 0) & (predicted == 0), "true_negative")
        .when((actual == 0) & (predicted == 1), "false_positive")
        .when((actual == 1) & (predicted == 0), "false_negative")
        .otherwise("true_positive")
    )


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """Division in DOUBLE; an empty denominator gives ``empty``."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty))


def edges_passed(value: Column, edges: Sequence[float], inclusive: bool = True) -> Column:
    """How many of the sorted ``edges`` lie at or below ``value``.

    A balanced tree of comparisons, so the cost per row is logarithmic and the
    expression stays inside generated code.
    """
    points = [float(e) for e in edges]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        passed = value >= points[middle] if inclusive else value > points[middle]
        return F.when(passed, search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(value.isNotNull(), search(0, len(points)))


def long_form(df, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value"):
    """One row per (row, column) as DOUBLE, without leaving generated code."""
    from pyspark.sql import types as T

    for column in columns:
        if not isinstance(df.schema[column].dataType, T.NumericType):
            raise ValueError(f"Column {column!r} is not numeric.")
    wide = df.select(*[quoted(k) for k in keep], *[quoted(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([quoted(k) for k in keep], [quoted(c) for c in columns], name, value)
