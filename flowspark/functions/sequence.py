"""Total orders at scale: dense positions, rolling windows and prefix sums.

A window without a partition key sends every row to one task, and a window over a
key that holds a third of the rows is nearly as bad.  Everything here cuts the
ordered rows into chunks of bounded size and carries the little that must cross a
chunk border, so no task ever sees more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.expr import edges_passed
from flowspark.session import collect_bounded, local_table, materialize

CHUNK_ROWS = 200_000


def with_sequence(df: DataFrame, order_by: Sequence[str], name: str = "seq") -> DataFrame:
    """Add the dense 0-based position of each row in the order of ``order_by``.

    One range shuffle sorts the data into ranges that are written once; the number
    of rows in each range (one record per written partition) gives the offsets.
    ``order_by`` has to identify a row for the positions to be reproducible.
    """
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(ranged, "ordered")
    sizes = collect_bounded(
        stored.groupBy("_range").agg(F.count("*").alias("n"), F.min("_place").alias("first")),
        "Range sizes",
        bound=2_000_000,
    )
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_range"]):
        offsets.append((row["_range"], total - row["first"]))
        total += row["n"]
    table = local_table(df.sparkSession, offsets, "_range int, _shift bigint")
    return (
        stored.join(table, "_range")
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_range", "_place", "_shift")
    )


def rolling(
    sequenced: DataFrame,
    outputs: dict[str, Callable],
    size: int,
    partition_by: Sequence[str] = (),
    seq: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Trailing windows of ``size`` rows evaluated chunk by chunk.

    ``outputs`` maps a new column name to a function of the window.  The last
    ``size - 1`` rows of a chunk are copied into the next one as context and
    dropped again afterwards, so results equal those of one global window.
    """
    if chunk_rows < size:
        raise ValueError("chunk_rows must be at least the window size.")
    home = F.floor(F.col(seq) / chunk_rows)
    lead_in = F.col(seq) % chunk_rows >= chunk_rows - (size - 1)
    spread = sequenced.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.when(lead_in, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
        ),
    )
    window = Window.partitionBy("_chunk", *partition_by).orderBy(seq).rowsBetween(-(size - 1), 0)
    result = spread.select("*", *[make(window).alias(column) for column, make in outputs.items()])
    return result.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def fill_gaps(
    sequenced: DataFrame,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    seq: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Forward fill, then back fill what is still missing at the front.

    Inside a chunk a window finds the nearest value.  Across chunks only the first
    and last known value per (chunk, group) travel: a table of summaries that is
    smaller than the data by the chunk size.
    """
    keys = ["_chunk", *partition_by]
    chunked = sequenced.withColumn("_chunk", F.floor(F.col(seq) / chunk_rows))
    edges = chunked.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_first_{c}") for c in columns],
    )
    group = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        *keys,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(later).alias(f"_after_{c}") for c in columns],
    )
    inside = Window.partitionBy(*keys).orderBy(seq)
    backward = inside.rowsBetween(Window.unboundedPreceding, 0)
    forward = inside.rowsBetween(0, Window.unboundedFollowing)
    filled = chunked.join(carried, keys).withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(backward),
                F.col(f"_before_{c}"),
                F.first(c, ignorenulls=True).over(forward),
                F.col(f"_after_{c}"),
            )
            for c in columns
        }
    )
    return filled.select(*sequenced.columns)


def running_total(sequenced: DataFrame, column: str, name: str, seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the sum of ``column`` over all rows up to and including each one; one number a chunk crosses borders."""
    chunked = materialize(sequenced.withColumn("_chunk", F.floor(F.col(seq) / chunk_rows)), "chunks")
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # over one row a chunk
    totals = chunked.groupBy("_chunk").agg(F.sum(column).alias("_sum"))
    offsets = totals.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(offsets, "_chunk").withColumn(name, F.col("_before") + F.sum(column).over(inside))
    return joined.drop("_chunk", "_before")


def quantile_edges(
    df: DataFrame, value: str, rows_per_bucket: int = CHUNK_ROWS, max_buckets: int = 16_384
) -> list[float]:
    """Cut points that put about ``rows_per_bucket`` rows between neighbours.

    Sketch based: only the balance of the buckets depends on its accuracy, never a
    result.  A value that repeats very often yields one cut point, not many.
    """
    rows = df.select(value).where(F.col(value).isNotNull()).count()
    wanted = min(max_buckets, -(-rows // rows_per_bucket))
    if wanted <= 1:
        return []
    grid = [i / wanted for i in range(1, wanted)]
    points = df.agg(F.percentile_approx(value, grid, max(1000, 4 * wanted)).alias("points")).first()["points"]
    return sorted({float(p) for p in points})


def add_bucket(df: DataFrame, value: str, edges: Sequence[float], name: str) -> DataFrame:
    """Number of edges at or below ``value``; binary search on either path."""
    if len(edges) <= 64:
        return df.withColumn(name, edges_passed(F.col(value), edges))
    splits = [float("-inf"), *edges, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep")
    return bucketizer.transform(df).withColumn(name, F.col(name).cast("int"))


def running_sums(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    edges: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running totals ``cum_<column>`` from the largest ``order`` downwards.

    ``counts`` has one row per (keys, order).  Totals per bucket are accumulated
    first; the rows of one bucket then only add that offset to their own running
    sum, so the sort is spread over all buckets instead of one task.
    """
    bucketed = add_bucket(counts, order, edges, "_bucket")
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = group.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_total_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = bucketed.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *counts.columns,
        "_bucket",
        *[(F.col(f"_above_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums],
    )
