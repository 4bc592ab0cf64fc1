"""What the operators share: registry, hashing, written tables, Arrow helpers and a bounded membership filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import materialize, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

U64 = np.uint64
# Odd multipliers of the SplitMix64 finaliser.
MIX_A, MIX_B, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

# Rows of an Arrow batch: texts have kilobytes, so that Spark's 10,000 rows would be tens of megabytes a task.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

# A membership filter never has more bits than this (32 MB); beyond, it prunes less and stays right.
MAX_FILTER_BITS = 1 << 28
SEGMENT_BITS = 1 << 19


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that no other column of the input can clash.

    Workers get the package, and texts reach them in batches of at most ``BATCH_ROWS`` rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def written(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, f"llm-{name}")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of the input; it only decides into how many buckets work is dealt."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int) -> int:
    """Number of buckets that grows with the input, at least the number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(1 << 20, max(least, math.ceil(input_bytes(df) / bytes_each))))


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over the 64-bit result."""
    h = (h ^ (h >> U64(30))) * MIX_A
    h = (h ^ (h >> U64(27))) * MIX_B
    return h ^ (h >> U64(31))


def seeds(count: int, seed: int, dtype=np.uint64) -> np.ndarray:
    """Reproducible random constants."""
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, count, dtype=dtype)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def numbers_of(column: pa.Array) -> np.ndarray:
    """A long column without nulls as a writable array."""
    return np.array(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column holds about ``most`` bytes in each piece (one row at least)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += size
        if b.num_rows > start:
            yield b.slice(start)


def _filter_positions(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) ^ GOLDEN)
    return h & U64(bits - 1), (h >> U64(32)) & U64(bits - 1)


class Membership:
    """A Bloom filter with two positions a key; it may keep a stranger, it never loses a member."""

    def __init__(self, spark: SparkSession, ids: DataFrame):
        """``ids``: one long column, best without repeats.  The bits are set in tasks, a segment in one task; at most 32 MB reach the driver."""
        (name,) = ids.columns
        count = ids.count()
        self.bits = bits = min(MAX_FILTER_BITS, max(SEGMENT_BITS, 1 << math.ceil(math.log2(12 * count + 1))))

        def positions(batches):
            for b in batches:
                spots = np.concatenate(_filter_positions(numbers_of(b.column(0)), bits)).astype(np.int64)
                yield batch(segment=spots // SEGMENT_BITS, spot=spots % SEGMENT_BITS)

        def segments(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                segment, spot = numbers_of(b.column(0)), numbers_of(b.column(1))
                for s in np.unique(segment):
                    flags = held.setdefault(int(s), np.zeros(SEGMENT_BITS, np.bool_))
                    flags[spot[segment == s]] = True
            for s, flags in held.items():
                yield batch(segment=[s], flags=pa.array([np.packbits(flags).tobytes()], pa.binary()))

        spots = ids.where(F.col(name).isNotNull()).mapInArrow(positions, "segment long, spot long")
        rows = spots.repartition("segment").mapInArrow(segments, "segment long, flags binary").collect()
        flags = np.zeros(bits // 8, np.uint8)
        for r in rows:
            at = r.segment * (SEGMENT_BITS // 8)
            flags[at : at + SEGMENT_BITS // 8] |= np.frombuffer(bytes(r.flags), np.uint8)
        self.shared = spark.sparkContext.broadcast(flags)

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function for use in tasks: long array -> may it be a member?"""
        shared, bits = self.shared, self.bits

        def test(ids: np.ndarray) -> np.ndarray:
            flags = shared.value
            keep = np.ones(len(ids), np.bool_)
            for spots in _filter_positions(ids, bits):
                spots = spots.astype(np.int64)
                keep &= (flags[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1 == 1
            return keep

        return test
