"""Calibration, drift and governance."""

from pyspark.sql import functions as F

from checks.base import FEATURES, FLOW_SQL, decided, flow, query, rounded
from checks.metrics import CELLS, CURVE, DECIDED
from flowspark.operators import drift, governance, metrics

TRAIN_SQL = FLOW_SQL + ", a AS (SELECT * FROM flow WHERE l_linestatus = 'O'), b AS (SELECT * REPLACE (l_quantity + 20 AS l_quantity) FROM flow WHERE l_linestatus = 'F')"


def _train(spark, folder):
    return flow(spark, folder).where("l_linestatus = 'O'")


def _fresh(spark, folder):
    return flow(spark, folder).where("l_linestatus = 'F'").withColumn("l_quantity", F.col("l_quantity") + 20)


@query("calibration", f"""WITH {FLOW_SQL}, e AS (SELECT quantile_cont(p, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS edges FROM flow),
    b AS (SELECT p, label, CAST(len(list_filter(edges, lambda x: x < p)) AS INT) AS bin FROM flow, e)
    SELECT bin, round(avg(p), 6) AS mean_predicted_probability, round(avg(label), 6) AS observed_attack_rate, count(*) AS samples
    FROM b GROUP BY bin""")
def calibration(spark, folder):
    return rounded(drift.calibration_table(flow(spark, folder), "label", "p"))


@query("brier", f"WITH {FLOW_SQL} SELECT round(avg((p - label) * (p - label)), 6) AS brier_score FROM flow")
def brier(spark, folder):
    return rounded(drift.brier_score(flow(spark, folder), "label", "p"))


GRID = "[" + ", ".join(f"{i}e-1" for i in range(10)) + ", 1e0]"


def baseline_sql(columns: list[str]) -> str:
    """(feature, bin, lower, upper, share) of table ``a`` and bin counts of table ``b``."""
    listed = ", ".join(columns)
    return f"""la AS (UNPIVOT (SELECT {listed} FROM a) ON {listed} INTO NAME feature VALUE x),
    lb AS (UNPIVOT (SELECT {listed} FROM b) ON {listed} INTO NAME feature VALUE x),
    e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {GRID}))) AS edges, avg(x) AS mean, stddev_pop(x) AS std,
      count(*) AS finite_rows FROM la GROUP BY feature),
    e AS (SELECT feature, CASE WHEN len(edges) = 1 THEN [edges[1] - 5e-1, edges[1] + 5e-1] ELSE edges END AS edges, mean, std, finite_rows FROM e0),
    bins AS (SELECT feature, edges, mean, std, finite_rows, unnest(range(len(edges) - 1)) AS bin FROM e),
    ca AS (SELECT la.feature, greatest(least(len(list_filter(edges, lambda v: v <= x)), len(edges) - 1) - 1, 0) AS bin, count(*) AS n
      FROM la JOIN e ON la.feature = e.feature GROUP BY 1, 2),
    cb AS (SELECT lb.feature, greatest(least(len(list_filter(edges, lambda v: v <= x)), len(edges) - 1) - 1, 0) AS bin, count(*) AS n
      FROM lb JOIN e ON lb.feature = e.feature GROUP BY 1, 2),
    tb AS (SELECT feature, sum(n) AS n FROM cb GROUP BY feature),
    base AS (SELECT bins.feature, bins.bin, edges[bins.bin + 1] AS lower, edges[bins.bin + 2] AS upper,
      CAST(coalesce(ca.n, 0) AS DOUBLE) / finite_rows AS share, mean, std, finite_rows
      FROM bins LEFT JOIN ca ON bins.feature = ca.feature AND bins.bin = ca.bin),
    ps AS (SELECT base.feature, sum((coalesce(cb.n, 0) / CAST(tb.n AS DOUBLE) - share) * ln((coalesce(cb.n, 0) / CAST(tb.n AS DOUBLE) + 1e-6) / (share + 1e-6))) AS psi,
      CAST(max(tb.n) AS BIGINT) AS finite_rows FROM base JOIN tb ON base.feature = tb.feature
      LEFT JOIN cb ON base.feature = cb.feature AND base.bin = cb.bin GROUP BY base.feature)"""


@query("drift_baseline", f"""WITH {TRAIN_SQL}, {baseline_sql(FEATURES)} SELECT feature, CAST(bin AS INT) AS bin, round(lower, 4) AS lower,
    round(upper, 4) AS upper, round(share, 6) AS share, round(mean, 4) AS mean, round(std, 4) AS std, finite_rows FROM base""")
def drift_baseline(spark, folder):
    made = drift.drift_baseline(_train(spark, folder), FEATURES)
    bins = made.select("feature", "mean", "std", "finite_rows", "edges", F.posexplode("proportions").alias("bin", "share"))
    flat = bins.withColumns(
        {"lower": F.element_at("edges", F.col("bin") + 1), "upper": F.element_at("edges", F.col("bin") + 2)}
    )
    return rounded(flat.drop("edges"), 4, share=6)


@query("psi", f"""WITH {TRAIN_SQL}, {baseline_sql(FEATURES)} SELECT feature, 'ok' AS status, round(psi, 6) AS psi,
    psi >= 2e-1 AS drift_detected, finite_rows FROM ps""")
def psi(spark, folder):
    return rounded(drift.drift_report(_fresh(spark, folder), drift.drift_baseline(_train(spark, folder), FEATURES)))


PARTIAL = f"""WITH {TRAIN_SQL}, {baseline_sql(FEATURES)}, sm AS (SELECT
    coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (psi >= 2e-1 AND feature <> 'l_tax'), '') AS drifted_features,
    'l_tax' AS missing_features, true AS requires_review FROM ps)"""


def _summary(spark, folder):
    baseline = drift.drift_baseline(_train(spark, folder), FEATURES)
    return drift.drift_summary(drift.drift_report(_fresh(spark, folder).drop("l_tax"), baseline))


@query("drift_summary", f"{PARTIAL} SELECT drifted_features, missing_features, requires_review FROM sm")
def drift_summary(spark, folder):
    return _summary(spark, folder)


@query("drift_state", f"{PARTIAL} SELECT CASE WHEN requires_review THEN 'review_required' ELSE 'healthy' END AS state FROM sm")
def drift_state(spark, folder):
    return drift.drift_state(_summary(spark, folder))


@query("calibration_summary", f"""WITH {FLOW_SQL}, {CURVE}, e AS (SELECT quantile_cont(p, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS edges FROM flow)
    SELECT round(avg((p - label) * (p - label)), 6) AS brier_score, (SELECT round(sum(pos / tp * cp / (cp + cn)), 6) FROM cu) AS average_precision,
    CAST(10 AS INT) AS bins_requested, count(DISTINCT len(list_filter(edges, lambda x: x < p))) AS bins_nonempty FROM flow, e""")
def calibration_summary(spark, folder):
    return rounded(drift.calibration_summary(flow(spark, folder), "label", "p"))


@query("representative_report", f"""WITH {DECIDED.replace('FROM lineitem', "FROM lineitem WHERE l_linestatus = 'F'")}, {CURVE}, cc AS (SELECT {CELLS} FROM dec)
    SELECT tn, fp, fn, tp, round(CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), 6) AS accuracy,
    (SELECT round(sum(neg * (cp - pos / 2)) / max(tp * tn), 6) FROM cu) AS roc_auc,
    (SELECT round(avg((p - label) * (p - label)), 6) FROM dec) AS brier_score FROM cc""")
def representative_report(spark, folder):
    rows = decided(spark, folder).where("l_linestatus = 'F'")
    judged = metrics.binary_metrics(rows, "label", "prediction", "p")
    both = metrics.beside(judged, drift.brier_score(rows, "label", "p"))
    return rounded(both.select("tn", "fp", "fn", "tp", "accuracy", "roc_auc", "brier_score"))


@query("manifest", f"WITH {FLOW_SQL} SELECT CAST(label AS VARCHAR) AS label, count(*) AS rows FROM flow GROUP BY label")
def manifest(spark, folder):
    return governance.label_counts(flow(spark, folder))


@query("fingerprint")
def fingerprint(spark, folder):
    return governance.fingerprint(flow(spark, folder))


@query("quality_gate", f"""WITH {DECIDED}, m AS (SELECT l_linestatus, CAST(sum(label * prediction) AS DOUBLE) / sum(label) AS recall,
      CAST(sum((1 - label) * prediction) AS DOUBLE) / sum(1 - label) AS fpr FROM dec GROUP BY l_linestatus),
    r AS (SELECT CASE l_linestatus WHEN 'O' THEN 'validation' ELSE 'test' END AS part, recall, fpr FROM m)
    SELECT part || '_recall' AS rule, round(recall, 6) AS observed, 48e-2 AS required, recall >= 48e-2 AS passed FROM r
    UNION ALL SELECT part || '_fpr', round(fpr, 6), 2e-1, fpr <= 2e-1 FROM r
    UNION ALL SELECT 'threshold_is_candidate', 5e-1, NULL, true""")
def quality_gate(spark, folder):
    rows = decided(spark, folder)
    validation = metrics.binary_metrics(rows.where("l_linestatus = 'O'"), "label", "prediction")
    test = metrics.binary_metrics(rows.where("l_linestatus = 'F'"), "label", "prediction")
    return rounded(governance.quality_gate(validation, test, 0.48, 0.2, 0.5, [0.4, 0.5]))
