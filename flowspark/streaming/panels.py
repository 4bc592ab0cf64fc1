"""Windowed alert panels; the same expressions serve a stream and a finished table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.expr import quoted
from flowspark.functions.quantiles import group_quantile_table
from flowspark.session import scratch_path

PANEL_WINDOW = "5 minutes"
SLIDE = "1 minute"
PANEL_SECONDS = 300.0
LATENESS = "10 minutes"
QUANTILES, QUANTILE_NAMES = (0.5, 0.95, 0.99), ("p50", "p95", "p99")
LATENCY_SKETCH = 200  # size of a sketch: ranks are off by about 1.3 percent

# Upper bounds of the batch-size histogram.
BATCH_SIZE_BUCKETS = (1.0, 10.0, 100.0, 1000.0, 10000.0)


def event_time(df: DataFrame, ts: str, lateness: str = LATENESS) -> DataFrame:
    """Event time as an instant with a watermark (zone-less times cannot carry one)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def _flat(windowed: DataFrame, *columns) -> DataFrame:
    return windowed.select(F.col("window.start").alias("window_start"), *columns)


def alert_volume(df: DataFrame, ts: str, alert: str = "is_alert", window: str = PANEL_WINDOW) -> DataFrame:
    """Alerts per window."""
    counted = df.groupBy(F.window(ts, window)).agg(F.count(F.when(F.col(alert), 1)).alias("alerts"))
    return _flat(counted, "alerts")


def flow_volume(df: DataFrame, ts: str, version: str = "model_version") -> DataFrame:
    """Flows per second by model version over a sliding window."""
    counted = df.groupBy(F.window(ts, PANEL_WINDOW, SLIDE), version).agg(F.count("*").alias("flows"))
    return _flat(counted, version, "flows", (F.col("flows").cast("double") / PANEL_SECONDS).alias("flows_per_second"))


def error_ratio(df: DataFrame, ts: str, invalid: str = "is_invalid", window: str = PANEL_WINDOW) -> DataFrame:
    """Share of unusable rows per window."""
    counted = df.groupBy(F.window(ts, window)).agg(
        F.count(F.when(F.col(invalid), 1)).alias("errors"), F.count("*").alias("requests")
    )
    share = F.col("errors").cast("double") / F.greatest(F.col("requests"), F.lit(1))
    return _flat(counted, "errors", "requests", share.alias("error_ratio"))


def batch_size_histogram(df: DataFrame, batch: str, buckets: Sequence[float] = BATCH_SIZE_BUCKETS) -> DataFrame:
    """Batches whose number of rows does not exceed each bound, plus the total."""
    sizes = df.groupBy(batch).agg(F.count("*").alias("rows"))
    bounds = F.array(*[F.lit(float(b)) for b in buckets], F.lit(float("inf")))
    reached = sizes.select(F.explode(F.filter(bounds, lambda b: F.col("rows") <= b)).alias("upper"))
    counted = reached.groupBy("upper").agg(F.count("*").alias("batches"))
    label = F.when(F.col("upper") == float("inf"), "+Inf").otherwise(F.col("upper").cast("bigint").cast("string"))
    return counted.select(label.alias("le"), "batches")


def latency_percentiles(df: DataFrame, key: str, latency: str) -> DataFrame:
    """p50 / p95 / p99, mean and number of requests per key, linearly interpolated, for any number of keys."""
    exact = group_quantile_table(df, [key], latency, QUANTILES)
    quantiles = exact.select(quoted(key), *[F.col(f"q{i}").alias(n) for i, n in enumerate(QUANTILE_NAMES)])
    basic = df.groupBy(key).agg(F.avg(latency).alias("mean"), F.count(latency).alias("requests"))
    return basic.join(quantiles, key)


def latency_panel(df: DataFrame, ts: str, key: str, latency: str, window: str = PANEL_WINDOW) -> DataFrame:
    """p50 / p95 / p99 per window and key from mergeable sketches, whose state has a bounded size whatever arrives."""
    sketch = F.kll_sketch_agg_double(F.col(latency).cast("double"), LATENCY_SKETCH)
    counted = df.groupBy(F.window(ts, window), key).agg(sketch.alias("sketch"), F.count(latency).alias("requests"))
    read = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in QUANTILES]))
    filled = F.when(F.col("requests") > 0, read)
    return _flat(counted, key, *[filled[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)], "requests")


def run_to_table(panel: DataFrame, keys: Sequence[str], name: str, path: str | None = None, wait: float | None = None) -> DataFrame:
    """Run a streaming panel over everything available and return its final rows.

    Every micro-batch writes the groups it changed to its own folder, so a repeated
    batch replaces itself; the newest version of each group is the result.  Windows
    that the watermark has not closed yet are included.
    """
    spark = panel.sparkSession
    target = path or scratch_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/table/batch={number}")

    query = (
        panel.writeStream.outputMode("update")
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{target}/checkpoint")
        .foreachBatch(store)
        .start()
    )
    if wait is None:
        query.awaitTermination()
    elif not query.awaitTermination(int(wait)):
        query.stop()
        raise TimeoutError(f"The stream {name!r} did not finish in {wait} seconds.")
    versions = spark.read.parquet(f"{target}/table")
    values = [c for c in versions.columns if c not in {*keys, "batch"}]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


