"""Seeded, engine-independent pseudo-random order for rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(row_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that depend only on the seed and the row id."""
    return F.md5(F.concat(F.lit(f"{int(seed)}|"), row_id.cast("string")))


def hash_number(text_hash: Column, digits: int = 15) -> Column:
    """Leading hexadecimal digits as a non-negative BIGINT (15 digits = 60 bits)."""
    return F.conv(F.substring(text_hash, 1, digits), 16, 10).cast("bigint")
