"""Confusion counts, ranking curves, the threshold policy and fold summaries."""

from pyspark.sql import functions as F

from checks.base import FLOW_SQL, decided, flow, query, rounded, table
from flowspark.operators import metrics

CLASSES = ["A", "N", "R"]

DECIDED = FLOW_SQL + ", dec AS (SELECT *, CAST(CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS INT) AS prediction FROM flow)"
CELLS = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""
RATES = """round(CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), 6) AS accuracy,
    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0), 6) AS specificity,
    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS sensitivity,
    round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0), 6) AS fpr,
    round(coalesce(CAST(fn AS DOUBLE) / nullif(fn + tp, 0), 0), 6) AS fnr"""
CURVE = """sc AS (SELECT p, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM flow GROUP BY p),
    cu AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn,
      sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM sc)"""


@query("confusion", f"WITH {DECIDED} SELECT {CELLS} FROM dec")
def confusion(spark, folder):
    return metrics.confusion_counts(decided(spark, folder), "label", "prediction")


@query("binary_metrics", f"""WITH {DECIDED}, {CURVE}, cc AS (SELECT {CELLS} FROM dec)
    SELECT tn, fp, fn, tp, {RATES}, (SELECT round(sum(neg * (cp - pos / 2)) / max(tp * tn), 6) FROM cu) AS roc_auc,
    (SELECT round(sum(pos * cp / (cp + cn)) / max(tp), 6) FROM cu) AS pr_auc FROM cc""")
def binary_metrics(spark, folder):
    return rounded(metrics.binary_metrics(decided(spark, folder), "label", "prediction", "p"))


MULTI = """mu AS (SELECT l_returnflag AS actual,
    CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted FROM lineitem)"""


def _multi(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        "l_returnflag AS actual",
        "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted",
    )


@query("confusion_multi", f"WITH {MULTI} SELECT actual, predicted, count(*) AS n FROM mu GROUP BY actual, predicted")
def confusion_multi(spark, folder):
    return metrics.confusion_matrix(_multi(spark, folder), "actual", "predicted")


@query("class_report", f"""WITH {MULTI}, k AS (SELECT unnest({CLASSES!r}) AS class),
    e AS (SELECT class, (SELECT count(*) FROM mu WHERE actual = class) AS support,
      (SELECT count(*) FROM mu WHERE predicted = class) AS claimed,
      (SELECT count(*) FROM mu WHERE actual = class AND predicted = class) AS hits FROM k),
    r AS (SELECT class, CAST(hits AS DOUBLE) / claimed AS pr, CAST(hits AS DOUBLE) / support AS re,
      CAST(2 * hits AS DOUBLE) / (claimed + support) AS f, support, hits FROM e)
    SELECT class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, support FROM r
    UNION ALL SELECT 'accuracy', round(CAST(sum(hits) AS DOUBLE) / sum(support), 6), round(CAST(sum(hits) AS DOUBLE) / sum(support), 6),
      round(CAST(sum(hits) AS DOUBLE) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
      round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def class_report(spark, folder):
    return rounded(metrics.class_report(_multi(spark, folder), "actual", "predicted", CLASSES))


@query("roc_auc", f"""WITH {FLOW_SQL}, r AS (SELECT label, avg(rn) OVER (PARTITION BY p) AS rk FROM
      (SELECT label, p, CAST(row_number() OVER (ORDER BY p) AS DOUBLE) AS rn FROM flow)),
    s AS (SELECT sum(rk) FILTER (label = 1) AS rs, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS np,
      CAST(count(*) FILTER (label = 0) AS DOUBLE) AS nn FROM r)
    SELECT round((rs - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM s""")
def roc_auc(spark, folder):
    return rounded(metrics.ranking_scores(flow(spark, folder), "label", "p").select("roc_auc"))


@query("avg_precision", f"WITH {FLOW_SQL}, {CURVE} SELECT round(sum(pos / tp * cp / (cp + cn)), 6) AS pr_auc FROM cu")
def avg_precision(spark, folder):
    return rounded(metrics.ranking_scores(flow(spark, folder), "label", "p").select("pr_auc"))


@query("fine_ranking", f"""WITH {FLOW_SQL}, x AS (SELECT label, l_extendedprice AS p FROM flow), {CURVE.replace('flow', 'x')}
    SELECT round(sum(neg * (cp - pos / 2)) / max(tp * tn), 6) AS roc_auc, round(sum(pos / tp * cp / (cp + cn)), 6) AS pr_auc FROM cu""")
def fine_ranking(spark, folder):
    """A score with about as many distinct values as rows."""
    return rounded(metrics.ranking_scores(flow(spark, folder), "label", "l_extendedprice"))


@query("roc_curve", f"""WITH {FLOW_SQL}, {CURVE}, n AS (SELECT *, lead(pos) OVER (ORDER BY p DESC) AS np,
      lead(neg) OVER (ORDER BY p DESC) AS nn, row_number() OVER (ORDER BY p DESC) AS i FROM cu)
    SELECT p AS threshold, round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM n
    WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT NULL, 0e0, 0e0""")
def roc_curve(spark, folder):
    return rounded(metrics.roc_points(flow(spark, folder), "label", "p"))


@query("pr_curve", f"""WITH {FLOW_SQL}, {CURVE} SELECT p AS threshold, round(cp / (cp + cn), 6) AS "precision",
    round(cp / tp, 6) AS recall FROM cu UNION ALL SELECT NULL, 1e0, 0e0""")
def pr_curve(spark, folder):
    return rounded(metrics.pr_points(flow(spark, folder), "label", "p"))


def sweep_sql(min_recall: str, max_fpr: str) -> str:
    listed = ", ".join(f"({c!r}e0)" for c in metrics.THRESHOLD_CANDIDATES)
    return f"""ca(threshold) AS (VALUES {listed}), w AS (SELECT threshold, count(*) FILTER (label = 1 AND p >= threshold) AS tp,
      count(*) FILTER (label = 0 AND p >= threshold) AS fp, count(*) FILTER (label = 1 AND p < threshold) AS fn,
      count(*) FILTER (label = 0 AND p < threshold) AS tn FROM flow, ca GROUP BY threshold),
    sw AS (SELECT threshold, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS "precision", CAST(tp AS DOUBLE) / (tp + fn) AS recall,
      CAST(fp AS DOUBLE) / (fp + tn) AS fpr, fp AS false_positives, fn AS false_negatives,
      CAST(tp AS DOUBLE) / (tp + fn) >= {min_recall} AND CAST(fp AS DOUBLE) / (fp + tn) <= {max_fpr} AS meets_targets FROM w)"""


SWEEP_OUT = 'threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(fpr, 6) AS fpr, false_positives, false_negatives, meets_targets'


@query("threshold_sweep", f"WITH {FLOW_SQL}, {sweep_sql('8e-1', '85e-2')} SELECT {SWEEP_OUT} FROM sw")
def threshold_sweep(spark, folder):
    return rounded(metrics.threshold_sweep(flow(spark, folder), "label", "p", min_recall=0.8, max_fpr=0.85))


@query("threshold_choice", f"""WITH {FLOW_SQL}, {sweep_sql('8e-1', '85e-2')}
    SELECT {SWEEP_OUT} FROM sw WHERE meets_targets ORDER BY threshold DESC LIMIT 1""")
def threshold_choice(spark, folder):
    sweep = metrics.threshold_sweep(flow(spark, folder), "label", "p", min_recall=0.8, max_fpr=0.85)
    return rounded(metrics.choose_threshold(sweep))


@query("threshold_fallback", f"""WITH {FLOW_SQL}, {sweep_sql('92e-2', '5e-3')}
    SELECT {SWEEP_OUT} FROM sw ORDER BY recall DESC, fpr, threshold DESC LIMIT 1""")
def threshold_fallback(spark, folder):
    return rounded(metrics.choose_threshold(metrics.threshold_sweep(flow(spark, folder), "label", "p")))


BY_FOLD = DECIDED + f", cc AS (SELECT CAST(l_linenumber AS INT) AS fold, {CELLS} FROM dec GROUP BY l_linenumber)"


def _fold_metrics(spark, folder):
    rows = decided(spark, folder).withColumn("fold", F.col("l_linenumber").cast("int"))
    return metrics.binary_metrics(rows, "label", "prediction", keys=["fold"])


@query("fold_metrics", f"WITH {BY_FOLD} SELECT fold, tn, fp, fn, tp, {RATES} FROM cc")
def fold_metrics(spark, folder):
    return rounded(_fold_metrics(spark, folder))


@query("fold_summary", f"""WITH {BY_FOLD}, m AS (SELECT fold, {RATES.replace('round(', '(').replace(', 6)', ')')} FROM cc),
    l AS (UNPIVOT m ON accuracy, "precision", recall, f1, specificity, fpr, fnr INTO NAME metric VALUE v)
    SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY metric""")
def fold_summary(spark, folder):
    return rounded(metrics.fold_summary(_fold_metrics(spark, folder)))


@query("policy_flags", f"""WITH {BY_FOLD}, m AS (SELECT fold, tn, fp, fn, tp, {RATES} FROM cc)
    SELECT fold, recall, fpr, recall >= 5e-1 AND fpr <= 5e-1 AS compliant FROM m""")
def policy_flags(spark, folder):
    flagged = metrics.policy_flags(_fold_metrics(spark, folder), 0.5, 0.5)
    return rounded(flagged.select("fold", "recall", "fpr", "compliant"))


@query("policy_all", f"""WITH {BY_FOLD}, m AS (SELECT fold, {RATES} FROM cc)
    SELECT bool_and(recall >= 5e-1 AND fpr <= 5e-1) AS all_compliant, count(*) AS folds FROM m""")
def policy_all(spark, folder):
    return metrics.all_compliant(metrics.policy_flags(_fold_metrics(spark, folder), 0.5, 0.5))


OUTCOME = """CASE WHEN label = 0 AND prediction = 0 THEN 'true_negative' WHEN label = 0 THEN 'false_positive'
    WHEN prediction = 0 THEN 'false_negative' ELSE 'true_positive' END AS outcome"""


@query("decision_outcome", f"""WITH {DECIDED} SELECT row_id, prediction, p AS probability, {OUTCOME},
    round(abs(p - 5e-1), 6) AS distance_from_threshold FROM dec""")
def decision_outcome(spark, folder):
    rows = metrics.with_outcome(decided(spark, folder), "label", "prediction", "p", 0.5)
    return rounded(rows.select("row_id", "prediction", F.col("p").alias("probability"), "outcome", "distance_from_threshold"))


@query("error_summary", f"""WITH {DECIDED}, o AS (SELECT p, {OUTCOME} FROM dec)
    SELECT outcome, count(*) AS samples, round(avg(p), 6) AS mean_attack_probability,
    round(quantile_cont(p, 5e-1), 6) AS median_attack_probability, round(avg(abs(p - 5e-1)), 6) AS mean_distance_from_threshold,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM o), 6) AS sample_fraction FROM o GROUP BY outcome""")
def error_summary(spark, folder):
    rows = metrics.with_outcome(decided(spark, folder), "label", "prediction", "p", 0.5)
    return rounded(metrics.error_summary(rows, "p"))


OVR_CLASSES = 10


@query("ovr_auc", f"""WITH k AS (SELECT unnest(range({OVR_CLASSES})) AS class),
    x AS (SELECT class, CAST(label = class AS INT) AS label, CAST(embedding[class + 1] AS DOUBLE) AS p FROM embeddings, k),
    sc AS (SELECT class, p, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM x GROUP BY class, p),
    cu AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY class ORDER BY p DESC) AS cn FROM sc),
    a AS (SELECT class, sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) AS roc, sum(pos * cp / (cp + cn)) / sum(pos) AS ap,
      sum(pos) AS support FROM cu GROUP BY class HAVING sum(pos) > 0)
    SELECT round(sum(roc * support) / sum(support), 6) AS roc_auc, round(sum(ap * support) / sum(support), 6) AS pr_auc,
    CAST(sum(support) AS BIGINT) AS support FROM a""")
def ovr_auc(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", F.slice("embedding", 1, OVR_CLASSES).alias("scores"))
    return rounded(metrics.one_vs_rest(rows, "label", "scores", list(range(OVR_CLASSES))))
