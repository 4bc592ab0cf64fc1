"""Training, scoring, importance, search and cross-validation on the whole flow view."""

import functools

from pyspark.sql import functions as F

from checks.base import FEATURES, FLOW_SQL, flow, query, rounded
from checks.ingest import export_csv
from checks.splits import ranked, shares
from flowspark.operators import models
from flowspark.operators.scale import apply_scaler, fit_scaler
from flowspark.plans.artifact import load_artifact
from flowspark.plans.scoring import batch_predict, predict_table
from flowspark.plans.training import Settings, create_holdout, cross_validate, evaluate_frozen, train_pipeline
from flowspark.session import scratch_path

# All parameters are the library's defaults.
SETTINGS = Settings(kind="gbt", min_recall=0.5, max_fpr=1.0)


def _scored(spark, folder, kind):
    rows = flow(spark, folder)
    scaled = apply_scaler(rows, fit_scaler(rows, FEATURES)).select("row_id", "label", *FEATURES)
    model = models.train(scaled, FEATURES, kind)
    return models.predict(scaled, model).select("row_id", "label", "probability", "prediction")


@query("rf_score")
def rf_score(spark, folder):
    return _scored(spark, folder, "random_forest")


@query("gbt_score")
def gbt_score(spark, folder):
    return _scored(spark, folder, "gbt")


@query("svc_score")
def svc_score(spark, folder):
    return _scored(spark, folder, "svm")


@query("tree_importance")
def tree_importance(spark, folder):
    rows = flow(spark, folder)
    return models.feature_importance(rows, models.train(rows, FEATURES, "random_forest"))


@query("train_report")
def train_report(spark, folder):
    _, reports = train_pipeline(flow(spark, folder), FEATURES, "label", "row_id", SETTINGS)
    return reports["metrics"]


@query("cv_report")
def cv_report(spark, folder):
    return cross_validate(flow(spark, folder), FEATURES, "label", "row_id", SETTINGS, folds=5)["fold_metrics"]


@query("search_report")
def search_report(spark, folder):
    _, report = models.randomized_search(flow(spark, folder), FEATURES, "label", "row_id", "gbt")
    return report


@query("perm_importance")
def perm_importance(spark, folder):
    rows = flow(spark, folder)
    scaled = apply_scaler(rows, fit_scaler(rows, FEATURES))
    model = models.train(scaled, FEATURES, "gbt")
    return models.permutation_importance(scaled, model, "label", "row_id", repeats=5)


@query("smote")
def smote(spark, folder):
    from flowspark.operators.smote import smote as balanced

    rows = flow(spark, folder).select("row_id", "label", *FEATURES)
    scaled = apply_scaler(rows, fit_scaler(rows, FEATURES))
    return balanced(scaled, FEATURES, "label", "row_id")


@query("smote_counts", f"""WITH {FLOW_SQL}, k AS (SELECT label, count(*) AS n FROM flow GROUP BY label), most AS (SELECT max(n) AS m FROM k)
    SELECT label, false AS synthetic, n AS made, n AS with_id, CAST(0 AS BIGINT) AS outside FROM k
    UNION ALL SELECT label, true, m - n, 0, 0 FROM k, most WHERE m > n""")
def smote_counts(spark, folder):
    """Rows of each class after balancing, those with an id, and those outside the box of their class."""
    made = smote(spark, folder)
    box = made.where("NOT synthetic").groupBy("label").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in FEATURES for f in (F.min, F.max)]
    )
    # A hair of slack for the last digit of the interpolation.
    inside = [F.col(c).between(F.col(f"min_{c}") - 1e-12, F.col(f"max_{c}") + 1e-12) for c in FEATURES]
    outside = F.count_if(~functools.reduce(lambda a, b: a & b, inside))
    return made.join(box, "label").groupBy("label", "synthetic").agg(
        F.count("*").alias("made"), F.count("row_id").alias("with_id"), outside.alias("outside")
    )


# A planted rule: what a model must find is known, so that SQL can state its answers.
PLANTED = "CAST(CASE WHEN l_quantity > 25 AND l_discount > 45e-3 THEN 1 ELSE 0 END AS INT)"
PLANTED_SQL = f"{FLOW_SQL}, planted AS (SELECT * EXCLUDE (label), {PLANTED} AS label FROM flow)"
RULE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def planted(spark, folder):
    return flow(spark, folder).withColumn("label", F.expr(PLANTED))


def _ruled(spark, folder, kind, rows=None, features=FEATURES):
    rows = planted(spark, folder) if rows is None else rows
    model = models.train(rows, features, kind)
    return models.predict(rows, model).select("row_id", "label", "prediction")


@query("rf_rule", f"WITH {PLANTED_SQL} SELECT row_id, label, label AS prediction FROM planted")
def rf_rule(spark, folder):
    return _ruled(spark, folder, "random_forest")


@query("gbt_rule", f"WITH {PLANTED_SQL} SELECT row_id, label, label AS prediction FROM planted")
def gbt_rule(spark, folder):
    return _ruled(spark, folder, "gbt")


RING = "power((l_quantity - 25) / 25, 2) + power((l_discount - 5e-2) / 5e-2, 2)"


@query("svc_rule", f"""WITH {FLOW_SQL}, ring AS (SELECT row_id, {RING} AS r FROM flow)
    SELECT row_id, CAST(CASE WHEN r < 4e-1 THEN 1 ELSE 0 END AS INT) AS label, CAST(CASE WHEN r < 4e-1 THEN 1 ELSE 0 END AS INT) AS prediction
    FROM ring WHERE r < 4e-1 OR r > 8e-1""")
def svc_rule(spark, folder):
    """Class 1 lies inside a ring of class 0, with an empty band between them."""
    rows = flow(spark, folder).withColumn("r", F.expr(RING)).where("r < 4e-1 OR r > 8e-1")
    rows = rows.withColumn("label", F.expr("CAST(CASE WHEN r < 4e-1 THEN 1 ELSE 0 END AS INT)"))
    return _ruled(spark, folder, "svm", rows, ["l_quantity", "l_discount"])


@query("importance_rule", f"""WITH {PLANTED_SQL} SELECT f AS feature, true AS impurity, true AS permutation
    FROM (SELECT unnest(['l_quantity', 'l_discount']) AS f) WHERE (SELECT count(*) FROM planted) > 0""")
def importance_rule(spark, folder):
    """The features of the rule stand out in both kinds of importance."""
    rows = planted(spark, folder)
    model = models.train(rows, RULE, "random_forest")
    impurity = models.feature_importance(rows, model)
    permuted = models.permutation_importance(rows, model, "label", "row_id", repeats=5)
    both = impurity.join(permuted, "feature").select("feature", (F.col("importance") > 0.2).alias("impurity"), (F.col("importance_mean") > 0.1).alias("permutation"))
    return both.where("impurity OR permutation")


@query("train_rule", f"""WITH {PLANTED_SQL}, {ranked('planted', 42)}, c AS (SELECT label, count(*) AS n FROM planted GROUP BY label),
    t AS (SELECT CAST(sum(n) - ceil(15e-2 * sum(n)) AS BIGINT) AS rest FROM c), {shares('c', '(SELECT rest FROM t)', 'a')},
    m AS (SELECT sum(CASE WHEN label = 0 THEN n - s ELSE 0 END) AS tn, sum(CASE WHEN label = 1 THEN n - s ELSE 0 END) AS tp FROM a)
    SELECT CAST(tn AS BIGINT) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
      1e0 AS accuracy, 1e0 AS recall, 0e0 AS fpr, 1e0 AS roc_auc, 1e0 AS pr_auc FROM m""")
def train_rule(spark, folder):
    _, reports = train_pipeline(planted(spark, folder), FEATURES, "label", "row_id", SETTINGS)
    return rounded(reports["metrics"].select("tn", "fp", "fn", "tp", "accuracy", "recall", "fpr", "roc_auc", "pr_auc"))


@query("cv_rule", f"""WITH {PLANTED_SQL},
    fd AS (SELECT label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5('42|' || row_id)) AS INT) AS fold FROM planted)
    SELECT fold, count(*) FILTER (label = 0) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, count(*) FILTER (label = 1) AS tp,
      1e0 AS recall, 0e0 AS fpr, 1e0 AS roc_auc, 1e0 AS pr_auc FROM fd GROUP BY fold""")
def cv_rule(spark, folder):
    report = cross_validate(planted(spark, folder), FEATURES, "label", "row_id", SETTINGS, folds=5)["fold_metrics"]
    return rounded(report.select("fold", "tn", "fp", "fn", "tp", "recall", "fpr", "roc_auc", "pr_auc"))


@query("search_rule", f"""WITH {PLANTED_SQL} SELECT CAST(k AS INT) AS candidate, 1e0 AS mean_average_precision, 0e0 AS std_average_precision
    FROM (SELECT unnest(range(1, 11)) AS k) WHERE (SELECT count(*) FROM planted) > 0""")
def search_rule(spark, folder):
    _, report = models.randomized_search(planted(spark, folder), RULE, "label", "row_id", "gbt")
    return rounded(report.drop("parameters"))


@query("release_rule", f"""WITH {PLANTED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS attacks FROM planted)
    SELECT unnest(['batch', 'frozen', 'table']) AS step, n AS "rows", attacks, n AS "right" FROM c""")
def release_rule(spark, folder):
    """A saved run, loaded again: it scores a table and exports, and is judged on labelled rows."""
    rows, path = planted(spark, folder), scratch_path(spark, "release")
    train_pipeline(rows, FEATURES, "label", "row_id", SETTINGS, "release", path)
    artifact = load_artifact(spark, path)
    scored = predict_table(rows, artifact, keep=["label"])
    judged = evaluate_frozen(rows, artifact, "label")
    seen = judged["identity"].first()["rows"]
    frozen = judged["metrics"].select(F.lit("frozen").alias("step"), F.lit(seen).cast("bigint").alias("rows"), (F.col("tp") + F.col("fp")).alias("attacks"), (F.col("tp") + F.col("tn")).alias("right"))
    _, paths = export_csv(rows.select(*FEATURES), "release-exports")
    batch = batch_predict(spark, artifact, paths, scratch_path(spark, "release-scores"))
    attacks = F.sum(F.col("prediction").cast("bigint")).alias("attacks")
    table = scored.agg(F.count("*").alias("rows"), attacks, F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    # Exports carry no label; as many attacks as the rule has are right.
    exported = batch.agg(F.count("*").alias("rows"), attacks, F.count("prediction").alias("right"))
    named = lambda df, step: df.select(F.lit(step).alias("step"), "rows", "attacks", "right")
    return named(table, "table").unionByName(frozen).unionByName(named(exported, "batch"))


@query("created_holdout", f"""WITH {FLOW_SQL}, {ranked('flow', 42)}, c AS (SELECT label, count(*) AS n FROM flow GROUP BY label),
    t AS (SELECT CAST(sum(n) - ceil(15e-2 * sum(n)) AS BIGINT) AS rest FROM c), {shares('c', '(SELECT rest FROM t)', 'a')}
    SELECT row_id, h.label, CASE WHEN r <= a.n - a.s THEN 'final_holdout' ELSE 'development' END AS part FROM h JOIN a ON h.label = a.label""")
def created_holdout(spark, folder):
    """Both published parts of the final holdout."""
    path = scratch_path(spark, "holdout")
    create_holdout(flow(spark, folder).select("row_id", "l_quantity", "label"), "label", "row_id", path)
    parts = [spark.read.parquet(f"{path}/{name}").select("row_id", "label", F.lit(name).alias("part")) for name in ("development", "final_holdout")]
    return parts[0].unionByName(parts[1])
