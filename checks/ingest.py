"""File sources, ingestion, external data, streams and panels."""

from pyspark.sql import functions as F

from checks.base import DIRTY_SQL, FLOW_SQL, NUMERIC_SQL, ROW_ID, dirty, flow, query, rounded, table
from flowspark.functions.quantiles import group_quantile_table
from flowspark.plans import scoring
from flowspark.session import scratch_path
from flowspark.sources import files, flowcsv
from flowspark.streaming import panels
from flowspark.streaming.monitor import FlowMonitor

# Older header spellings, so the alias rules are exercised.
OLD_HEADERS = {"quantity_text": " Total Length of Fwd Packets", "price_text": "Max Packet Length", "discount": " Init_Win_bytes_forward "}
CURRENT = ["Fwd Packets Length Total", "Packet Length Max", "Init Fwd Win Bytes"]
SCORE_SQL = "round(5e-1 * quantity / 5e1 + 5e-1 * discount / 1e-1, 6)"


def pseudo_score():
    return F.expr("round(5e-1 * `Fwd Packets Length Total` / 5e1 + 5e-1 * `Init Fwd Win Bytes` / 1e-1, 6)")


def export_csv(df, name):
    """Write CSV exports to the scratch folder; returns their paths in row order."""
    folder = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(folder)
    return folder, [p for p, _, _ in files.list_files(df.sparkSession, folder, ".csv")]


def old_style(spark, folder):
    return dirty(spark, folder).select(
        "row_id", "copy", *[F.col(k).cast("string").alias(v) for k, v in OLD_HEADERS.items()], F.col("label_text").alias(" Label")
    )


@query("header_normalise", f"""WITH {DIRTY_SQL} SELECT row_id, copy, quantity_text AS "Fwd Packets Length Total", price_text AS "Packet Length Max",
    CAST(discount AS VARCHAR) AS "Init Fwd Win Bytes", label_text AS "Label" FROM dirty""")
def header_normalise(spark, folder):
    return flowcsv.normalise_headers(old_style(spark, folder))


SCORED_SQL = NUMERIC_SQL + f""", sc AS (SELECT row_id, copy, CASE WHEN price IS NOT NULL AND discount IS NOT NULL THEN {SCORE_SQL} END AS probability FROM num),
    res AS (SELECT row_id, copy, 'v1' AS model_version, 5e-1 AS threshold, CAST(CASE WHEN probability >= 5e-1 THEN 1 WHEN probability IS NOT NULL THEN 0 END AS INT) AS prediction,
      probability, coalesce(probability >= 5e-1, false) AS is_alert, CASE WHEN probability IS NULL THEN 'invalid_input' ELSE 'scored' END AS score_status FROM sc)"""


def _scored(spark, folder):
    rows = flowcsv.normalise_headers(old_style(spark, folder))
    scorer = scoring.expression_scorer(pseudo_score())
    return scoring.score_rows(rows, CURRENT, scorer, 0.5, "v1", ["row_id", "copy"])


@query("score_export", f"WITH {SCORED_SQL} SELECT * FROM res")
def score_export(spark, folder):
    return _scored(spark, folder)


@query("ingest_manifest", f"""WITH {SCORED_SQL} SELECT count(*) AS rows_read, count(*) FILTER (score_status = 'scored') AS rows_scored,
    count(*) FILTER (score_status = 'invalid_input') AS rows_invalid_input, count(*) FILTER (is_alert) AS alerts,
    CAST(1 AS BIGINT) AS operating_points FROM res""")
def ingest_manifest(spark, folder):
    return scoring.ingest_counts(_scored(spark, folder))


@query("scored_files", f"""WITH {SCORED_SQL}, t AS (SELECT count(*) AS rows_read, count(*) FILTER (score_status = 'scored') AS rows_scored,
      count(*) FILTER (score_status = 'invalid_input') AS rows_invalid_input, count(*) FILTER (is_alert) AS alerts FROM res)
    SELECT prediction, is_alert, score_status, count(*) AS "rows", round(sum(probability), 3) AS probabilities, max(t.rows_read) AS rows_read, max(t.rows_scored) AS rows_scored,
    max(t.rows_invalid_input) AS rows_invalid_input, max(t.alerts) AS alerts FROM res, t GROUP BY prediction, is_alert, score_status""")
def scored_files(spark, folder):
    """The published table of a scoring run beside the counts of its manifest."""
    _, paths = export_csv(old_style(spark, folder), "scored")
    output = scratch_path(spark, "scores")
    done = scoring.score_flow_files(spark, paths, output, CURRENT, scoring.expression_scorer(pseudo_score()), 0.5, "v1", format="parquet")
    groups = spark.read.parquet(output).groupBy("prediction", "is_alert", "score_status").agg(F.count("*").alias("rows"), F.round(F.sum("probability"), 3).alias("probabilities"))
    return groups.withColumns({c: F.lit(done[c]).cast("bigint") for c in ("rows_read", "rows_scored", "rows_invalid_input", "alerts")})


@query("source_rows", f"SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM (SELECT {ROW_ID} FROM lineitem)")
def source_rows(spark, folder):
    """Row numbers inside sorted exports, put together to the position in the whole."""
    rows = flow(spark, folder).select("row_id", "l_quantity")
    ranges = max(6, -(-rows.count() // files.RANGE_ROWS))
    ordered = rows.repartitionByRange(ranges, "row_id").sortWithinPartitions("row_id")
    _, paths = export_csv(ordered, "sorted_export")
    numbered = flowcsv.number_rows(flowcsv.read_flows(spark, paths, ["row_id"]))
    sizes = {r[0]: r[1] for r in numbered.groupBy("source_file").agg(F.max("source_row") + 1).collect()}
    start, offset = {}, 0
    for path in sorted(sizes):
        start[path], offset = offset, offset + sizes[path]
    before = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
    return numbered.select("row_id", (F.element_at(before, F.col("source_file")) + F.col("source_row")).alias("position"))


@query("external_prepare", f"""WITH {NUMERIC_SQL.replace('discount, label FROM dirty', 'discount, label_text FROM dirty')} SELECT quantity AS "Fwd Packets Length Total", price AS "Packet Length Max", discount AS "Init Fwd Win Bytes",
    CAST(CASE WHEN trim(label_text) = 'BENIGN' THEN 0 ELSE 1 END AS INT) AS label FROM num
    WHERE price IS NOT NULL AND discount IS NOT NULL AND trim(label_text) <> ''""")
def external_prepare(spark, folder):
    _, paths = export_csv(old_style(spark, folder), "external")
    prepared, _ = flowcsv.prepare_external(flowcsv.read_flows(spark, paths, CURRENT, label=True), CURRENT)
    return prepared


@query("external_counts", f"""WITH {NUMERIC_SQL.replace('discount, label FROM dirty', 'discount, label_text FROM dirty')}, k AS (SELECT label_text,
      price IS NOT NULL AND discount IS NOT NULL AND coalesce(trim(label_text) <> '', false) AS kept FROM num)
    SELECT count(*) FILTER (kept) AS rows_written, count(*) FILTER (NOT kept) AS rows_dropped,
    count(*) FILTER (kept AND trim(label_text) = 'BENIGN') AS benign, count(*) FILTER (kept AND trim(label_text) <> 'BENIGN') AS attack FROM k""")
def external_counts(spark, folder):
    _, paths = export_csv(old_style(spark, folder), "external")
    _, counts = flowcsv.prepare_external(flowcsv.read_flows(spark, paths, CURRENT, label=True), CURRENT)
    return counts


@query("schema_preflight")
def schema_preflight(spark, folder):
    _, good = export_csv(old_style(spark, folder), "preflight")
    _, poor = export_csv(flow(spark, folder).select("row_id", "l_quantity", "label"), "preflight")
    return files.inspect_headers(files.csv_headers(spark, good + poor), CURRENT)


# What the header report must say of exports that have all features and of those that lack them.
FEATURES_SQL = ", ".join(f"'{c}'" for c in sorted(CURRENT))


@query("preflight_report", f"""WITH {FLOW_SQL}, k AS (SELECT label IS NOT NULL AS labelled, list_sort([{FEATURES_SQL}]) AS needed FROM flow LIMIT 1)
    SELECT CAST(len(needed) + 3 AS INT) AS columns_found, labelled AS label_column_present, '' AS missing_required_features, 0 AS missing_feature_count,
      '' AS duplicate_normalized_columns, labelled AS schema_compatible FROM k
    UNION ALL SELECT 3, labelled, array_to_string(needed, '; '), CAST(len(needed) AS INT), '', false FROM k""")
def preflight_report(spark, folder):
    """The distinct reports of two folders of exports, read from their headers."""
    reports = []
    for rows in (old_style(spark, folder), flow(spark, folder).select("row_id", "l_quantity", "label")):
        _, paths = export_csv(rows, "preflight")
        reports.append(files.inspect_headers(files.csv_headers(spark, paths), CURRENT))
    return reports[0].unionByName(reports[1]).drop("file").distinct()


def export_parquet(df, target, prefix):
    """Parquet files ``<prefix>_<n>.parquet`` in one folder."""
    spark = df.sparkSession
    staging = scratch_path(spark, prefix)
    df.write.parquet(staging)
    for i, (path, _, _) in enumerate(files.list_files(spark, staging, ".parquet")):
        files.rename(spark, path, f"{target}/{prefix}_{i}.parquet")


def _attack_files(spark, folder):
    target = scratch_path(spark, "attacks")
    export_parquet(flow(spark, folder).select("row_id", "l_quantity", F.col("label").cast("string").alias("Label")), target, "DDoS")
    export_parquet(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), target, "Bot")
    return target


@query("union_by_name", f"""WITH {FLOW_SQL} SELECT row_id, l_quantity, CAST(label AS VARCHAR) AS "Label", NULL AS o_orderkey, NULL AS o_totalprice FROM flow
    UNION ALL SELECT NULL, NULL, 'Bot', o_orderkey, o_totalprice FROM orders""")
def union_by_name(spark, folder):
    return files.union_files(spark, _attack_files(spark, folder))


@query("source_tag", f"""WITH {FLOW_SQL} SELECT row_id, NULL AS o_orderkey, 'DDoS' AS source FROM flow
    UNION ALL SELECT NULL, o_orderkey, 'Bot' FROM orders""")
def source_tag(spark, folder):
    return files.union_files(spark, _attack_files(spark, folder), "source").select("row_id", "o_orderkey", "source")


@query("stream_scored", f"WITH {SCORED_SQL} SELECT count(*) AS n, prediction, probability, is_alert, score_status FROM res GROUP BY ALL")
def stream_scored(spark, folder):
    """Exports dropped into a watched folder, scored by the stream."""
    root = scratch_path(spark, "watch")
    watched, _ = export_csv(old_style(spark, folder), "watched")
    monitor = FlowMonitor(
        spark, watched, f"{root}/alerts", f"{root}/processed", f"{root}/failed", CURRENT,
        scoring.expression_scorer(pseudo_score()), 0.5, "v1",
    )
    query = monitor.start(f"{root}/checkpoint", availableNow=True)
    query.awaitTermination()
    return monitor.scores().groupBy("prediction", "probability", "is_alert", "score_status").agg(F.count("*").alias("n"))


SCORED_EVENTS = "se AS (SELECT ts, event_type, value, event_type = 'error' AS is_alert, 'm' || CAST(user_id % 2 AS VARCHAR) AS model_version, user_id FROM events)"


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return panels.event_time(_scored_events(stream), "ts")


def _scored_events(events):
    return events.select(
        "ts",
        "event_type",
        "value",
        (F.col("event_type") == "error").alias("is_alert"),
        F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model_version"),
        "user_id",
    )


def _named_start(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


START = "strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start"


@query("alerts_5m", f"WITH {SCORED_EVENTS} SELECT {START}, count(*) FILTER (is_alert) AS alerts FROM se GROUP BY 1")
def alerts_5m(spark, folder):
    made = panels.alert_volume(_event_stream(spark, folder), "ts")
    return _named_start(panels.run_to_table(made, ["window_start"], "alerts"))


@query("error_ratio_5m", f"""WITH {SCORED_EVENTS} SELECT {START}, count(*) FILTER (is_alert) AS errors, count(*) AS requests,
    round(CAST(count(*) FILTER (is_alert) AS DOUBLE) / count(*), 6) AS error_ratio FROM se GROUP BY 1""")
def error_ratio_5m(spark, folder):
    made = panels.error_ratio(_event_stream(spark, folder), "ts", "is_alert")
    return rounded(_named_start(panels.run_to_table(made, ["window_start"], "errors")))


@query("volume_sliding", f"""WITH {SCORED_EVENTS}, k AS (SELECT unnest(range(5)) AS back),
    s AS (SELECT strftime(date_trunc('minute', ts) - INTERVAL 1 MINUTE * back, '%Y-%m-%d %H:%M:%S') AS window_start, model_version FROM se, k)
    SELECT window_start, model_version, count(*) AS flows, round(CAST(count(*) AS DOUBLE) / 300, 6) AS flows_per_second FROM s GROUP BY 1, 2""")
def volume_sliding(spark, folder):
    made = panels.flow_volume(_event_stream(spark, folder), "ts")
    return rounded(_named_start(panels.run_to_table(made, ["window_start", "model_version"], "volume")))


@query("batch_size_hist", f"""WITH {SCORED_EVENTS}, b AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id),
    le(u, le) AS (VALUES (1, '1'), (10, '10'), (100, '100'), (1000, '1000'), (10000, '10000'), (1000000000000, '+Inf'))
    SELECT le, count(*) AS batches FROM b, le WHERE n <= u GROUP BY le""")
def batch_size_hist(spark, folder):
    return panels.batch_size_histogram(_scored_events(table(spark, folder, "events")), "user_id")


@query("latency_percentiles", """SELECT event_type, round(avg(value), 6) AS mean, count(value) AS requests,
    round(quantile_cont(value, 5e-1), 6) AS p50, round(quantile_cont(value, 95e-2), 6) AS p95, round(quantile_cont(value, 99e-2), 6) AS p99
    FROM events GROUP BY event_type""")
def latency_percentiles(spark, folder):
    return rounded(panels.latency_percentiles(table(spark, folder, "events"), "event_type", "value"))


@query("latency_many_keys", """SELECT user_id, event_type, round(quantile_cont(value, 5e-1), 6) AS q0, round(quantile_cont(value, 9e-1), 6) AS q1
    FROM events GROUP BY user_id, event_type""")
def latency_many_keys(spark, folder):
    """A group for every user and kind of event: as many as there are, none of them held in one place."""
    return rounded(group_quantile_table(table(spark, folder, "events"), ["user_id", "event_type"], "value", [0.5, 0.9]))
