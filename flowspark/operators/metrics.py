"""Classification metrics, exact ranking curves and the threshold policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.expr import outcome, quoted, ratio
from flowspark.functions.quantiles import group_quantiles
from flowspark.functions.sequence import add_bucket, quantile_edges, running_sums
from flowspark.session import local_table

# Default operating points and alert policy.
THRESHOLD_CANDIDATES = (0.24, 0.25, 0.26, 0.27, 0.28, 0.29, 0.30, 0.31, 0.32, 0.33, 0.34, 0.35)
MIN_RECALL = 0.92
MAX_FPR = 0.005

SUMMARY_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "specificity", "fpr", "fnr")


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.first(quoted(c), ignorenulls=True).alias(c) for c in both.columns])


def confusion_counts(
    df: DataFrame, label: str, prediction: str, positive: object = 1, keys: Sequence[str] = ()
) -> DataFrame:
    """tn, fp, fn, tp per group of ``keys``; the positive class is named, not guessed."""
    actual = quoted(label) == F.lit(positive)
    alert = quoted(prediction) == F.lit(positive)
    cells = {"tn": ~actual & ~alert, "fp": ~actual & alert, "fn": actual & ~alert, "tp": actual & alert}
    return df.groupBy(*keys).agg(*[F.count(F.when(cell, 1)).alias(name) for name, cell in cells.items()])


def rates(counts: DataFrame) -> DataFrame:
    """Add the ratio metrics to tn / fp / fn / tp; empty denominators give 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": ratio(tn, tn + fp),
            "sensitivity": ratio(tp, tp + fn),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
        }
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Cells (actual, predicted, n) that occur."""
    return df.groupBy(quoted(label).alias("actual"), quoted(prediction).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def class_report(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """Precision, recall, f1 and support per class plus accuracy, macro and weighted rows.

    One pass reduces the data to the confusion cells; the caller declares the class
    list, so a class that happens to be absent still has its row.
    """
    cells = confusion_matrix(df, label, prediction).select(
        F.col("actual").cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted"), "n"
    )
    names = local_table(df.sparkSession, [(str(c),) for c in classes], "class string")
    # Each cell counts as support of one class and as prediction of one class.
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])
    per_class = names.join(sums, "class", "left").na.fill(0).select(
        "class",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = per_class.agg((F.sum("hits").cast("double") / total).alias("a"), total.alias("support")).select(
        F.lit("accuracy").alias("class"), *[F.col("a").alias(s) for s in scores], "support"
    )
    macro = per_class.agg(F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores], total.alias("support"))
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(s) * F.col("support")) / total).alias(s) for s in scores],
        total.alias("support"),
    )
    return per_class.drop("hits").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score; equal scores combine map-side."""
    rows = F.col(weight) if weight else F.lit(1).cast("bigint")
    positive = quoted(label) == 1
    return df.groupBy(*keys, quoted(score).alias("score")).agg(
        F.sum(F.when(positive, rows).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(rows)).alias("neg"),
    )


def cumulative_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per distinct score: its own and the running positives / negatives, highest score first."""
    scored = df.where(quoted(score).isNotNull())
    edges = quantile_edges(scored.select(quoted(score).cast("double").alias("score")), "score")
    counts = score_counts(scored.withColumn(score, quoted(score).cast("double")), label, score, keys, weight)
    return running_sums(counts, "score", ["pos", "neg"], edges, keys)


def ranking_scores(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact ``roc_auc`` and ``pr_auc`` (average precision) per group; ``weight`` is the number of rows that a row stands for.

    Ties share one threshold: they count one half for the area and enter average
    precision together.  A group with a single class has no area (NULL).
    """
    curve = cumulative_counts(df, label, score, keys, weight)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    sums = curve.groupBy(*keys).agg(
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
        F.sum(neg * (cum_pos - pos / 2)).alias("_area"),
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("_ap"),
    )
    return sums.select(
        *keys,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_area") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def one_vs_rest(df: DataFrame, label: str, probabilities: str, classes: Sequence) -> DataFrame:
    """Support-weighted one-vs-rest ``roc_auc`` and ``pr_auc`` of a score array.

    Element i of the array belongs to ``classes[i]``; each row becomes one scored
    row per class and all classes are ranked in the same pass.
    """
    marked = df.select(
        quoted(label).alias("_label"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("class"), quoted(probabilities)[i].cast("double").alias("score"))
                    for i, c in enumerate(classes)
                ]
            )
        ).alias("_s"),
    ).select("_s.*", F.when(F.col("_label") == F.col("_s.class"), 1).otherwise(0).alias("hit"))
    scores = ranking_scores(marked, "hit", "score", ["class"])
    support = df.groupBy(quoted(label).alias("class")).agg(F.count("*").alias("support"))
    joined = scores.join(support, "class")
    total = F.sum("support")
    return joined.agg(
        (F.sum(F.col("roc_auc") * F.col("support")) / total).alias("roc_auc"),
        (F.sum(F.col("pr_auc") * F.col("support")) / total).alias("pr_auc"),
        total.alias("support"),
    )


def _totals(df: DataFrame, label: str, score: str) -> tuple[int, int]:
    present = quoted(score).isNotNull()
    row = df.agg(
        F.count(F.when(present & (quoted(label) == 1), 1)).alias("p"),
        F.count(F.when(present & (quoted(label) != 1), 1)).alias("n"),
    ).first()
    return row["p"], row["n"]


def roc_points(df: DataFrame, label: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, from a starting point at (0, 0).

    A point in the middle of a straight stretch is left out by default: the next
    distinct score adds exactly as many positives and negatives as this one did.
    """
    positives, negatives = _totals(df, label, score)
    curve = cumulative_counts(df, label, score)
    if drop_intermediate:
        # The next lower score may sit in another bucket, so each bucket also
        # learns the counts at the top of the nearest bucket below it.
        here = F.struct("pos", "neg")
        tops = curve.groupBy("_bucket").agg(F.max_by(here, "score").alias("_top"))
        below = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket"))
        following = tops.select("_bucket", F.lead("_top").over(below).alias("_next_top"))
        inside = Window.partitionBy("_bucket").orderBy(F.desc("score"))
        curve = curve.join(following, "_bucket").withColumn(
            "_next", F.coalesce(F.lead(here).over(inside), F.col("_next_top"))
        )
        is_first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        bend = (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
        curve = curve.where(is_first | F.col("_next").isNull() | bend)
    points = curve.select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.lit(negatives)).alias("fpr"),
        ratio(F.col("cum_pos"), F.lit(positives)).alias("tpr"),
    )
    start = local_table(df.sparkSession, [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, ending at precision 1, recall 0."""
    positives, _ = _totals(df, label, score)
    points = cumulative_counts(df, label, score).select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.lit(positives), 1.0).alias("recall"),
    )
    end = local_table(df.sparkSession, [(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def threshold_sweep(
    df: DataFrame,
    label: str,
    score: str,
    candidates: Sequence[float] = THRESHOLD_CANDIDATES,
    min_recall: float = MIN_RECALL,
    max_fpr: float = MAX_FPR,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Alert quality at every candidate threshold, from one pass over the scores.

    A row only notes how many candidates it reaches.  Counting those numbers leaves
    one record per (candidate, class), and sums over that small table give the
    confusion counts of every candidate; rows are never copied per candidate.
    """
    points = sorted({float(c) for c in candidates})
    if not points or any(not 0.0 < c < 1.0 for c in points):
        raise ValueError("Give at least one threshold to try, each from 0 to 1.")
    scored = df.select(*keys, quoted(label).alias("_y"), quoted(score).cast("double").alias("_p"))
    # A row without a score is neither an alert nor none.
    noted = add_bucket(scored.where(F.col("_p").isNotNull() & ~F.isnan("_p")), "_p", points, "_reached")
    counts = noted.groupBy(*keys, "_reached").agg(
        F.count(F.when(F.col("_y") == 1, 1)).alias("_pos"), F.count(F.when(F.col("_y") != 1, 1)).alias("_neg")
    )
    spread = counts.select("*", F.posexplode(F.lit(points)).alias("_i", "threshold"))
    reached = F.col("_reached") > F.col("_i")
    cells = spread.groupBy(*keys, "threshold").agg(
        F.sum(F.when(reached, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, 0).otherwise(F.col("_pos"))).alias("fn"),
        F.sum(F.when(reached, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(reached, 0).otherwise(F.col("_neg"))).alias("tn"),
    )
    scored = rates(cells)
    return scored.select(
        *keys,
        "threshold",
        "precision",
        "recall",
        "fpr",
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        ((F.col("recall") >= min_recall) & (F.col("fpr") <= max_fpr)).alias("meets_targets"),
    )


def choose_threshold(sweep: DataFrame, frozen: float | None = None) -> DataFrame:
    """The single operating point of a sweep.

    The highest compliant threshold raises the fewest alerts.  Without one, recall
    decides, then the false-positive rate, then the higher threshold.  A frozen
    threshold overrides the choice.
    """
    if frozen is not None:
        return sweep.where(F.col("threshold") == float(frozen))
    compliant = F.col("meets_targets")
    return sweep.orderBy(
        F.desc("meets_targets"),
        F.desc(F.when(compliant, F.col("threshold"))),
        F.desc(F.when(~compliant, F.col("recall"))),
        F.asc(F.when(~compliant, F.col("fpr"))),
        F.desc("threshold"),
    ).limit(1)


def select_threshold(
    df: DataFrame,
    label: str,
    score: str,
    candidates: Sequence[float] = THRESHOLD_CANDIDATES,
    min_recall: float = MIN_RECALL,
    max_fpr: float = MAX_FPR,
    frozen: float | None = None,
) -> tuple[float, DataFrame]:
    """Operating threshold and the sweep behind it."""
    sweep = threshold_sweep(df, label, score, candidates, min_recall, max_fpr)
    rows = sweep.collect()
    table = local_table(df.sparkSession, sorted(rows), sweep.schema)
    if frozen is not None:
        return float(frozen), table
    return float(choose_threshold(table).first()["threshold"]), table


def binary_metrics(
    df: DataFrame, label: str, prediction: str, score: str | None = None, positive: object = 1, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts, ratios and, with a score, both ranking metrics per group."""
    metrics = rates(confusion_counts(df, label, prediction, positive, keys))
    if score is None:
        return metrics
    marked = df.withColumn("_hit", F.when(quoted(label) == F.lit(positive), 1).otherwise(0))
    areas = ranking_scores(marked, "_hit", score, keys)
    return metrics.join(areas, list(keys)) if keys else beside(metrics, areas)


def evaluate(
    df: DataFrame,
    label: str,
    prediction: str,
    classes: Sequence,
    score: str | None = None,
    positive: object = 1,
) -> dict[str, DataFrame]:
    """Everything a run reports: metrics, matrix, per-class report and curves.

    ``classes`` is declared by the caller, so a sample that lacks a class is still
    judged by the rules for its task.
    """
    report = {
        "confusion_matrix": confusion_matrix(df, label, prediction),
        "classification_report": class_report(df, label, prediction, classes),
    }
    if len(classes) == 2:
        report["metrics"] = binary_metrics(df, label, prediction, score, positive)
        if score is not None:
            marked = df.withColumn("_hit", F.when(quoted(label) == F.lit(positive), 1).otherwise(0))
            report["roc_curve"] = roc_points(marked, "_hit", score)
            report["pr_curve"] = pr_points(marked, "_hit", score)
        return report
    weighted = report["classification_report"].where("class = 'weighted avg'").select("precision", "recall", "f1")
    accuracy = report["classification_report"].where("class = 'accuracy'").select(F.col("f1").alias("accuracy"))
    report["metrics"] = beside(accuracy, weighted)
    if score is not None:
        areas = one_vs_rest(df, label, score, classes).drop("support")
        report["metrics"] = beside(report["metrics"], areas)
    return report


def fold_summary(fold_metrics: DataFrame, metrics: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    present = [m for m in metrics if m in fold_metrics.columns]
    long = fold_metrics.select(*[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        [], present, "metric", "value"
    )
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def with_outcome(df: DataFrame, label: str, prediction: str, score: str, threshold: float) -> DataFrame:
    """Add the confusion cell and the distance of the score from the threshold."""
    return df.withColumns(
        {
            "outcome": outcome(quoted(label), quoted(prediction)),
            "distance_from_threshold": F.abs(quoted(score) - F.lit(float(threshold))),
        }
    )


def error_summary(diagnosed: DataFrame, score: str) -> DataFrame:
    """Per outcome: rows, mean and exact median score, mean distance and share of all rows."""
    sums = diagnosed.groupBy("outcome").agg(
        F.count("*").alias("samples"),
        F.avg(quoted(score)).alias("mean_attack_probability"),
        F.avg("distance_from_threshold").alias("mean_distance_from_threshold"),
    )
    found = group_quantiles(diagnosed, "outcome", score, [0.5])
    medians = local_table(
        diagnosed.sparkSession,
        [(k, v[0.5]) for k, v in found.items()],
        "outcome string, median_attack_probability double",
    )
    everything = Window.partitionBy(F.lit(0))
    return (
        sums.join(medians, "outcome", "left")
        .withColumn("sample_fraction", F.col("samples").cast("double") / F.sum("samples").over(everything))
        .select(
            "outcome",
            "samples",
            "mean_attack_probability",
            "median_attack_probability",
            "mean_distance_from_threshold",
            "sample_fraction",
        )
    )


def policy_flags(fold_metrics: DataFrame, min_recall: float = MIN_RECALL, max_fpr: float = MAX_FPR) -> DataFrame:
    """Whether each fold satisfies the alert policy."""
    return fold_metrics.withColumn("compliant", (F.col("recall") >= min_recall) & (F.col("fpr") <= max_fpr))


def all_compliant(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.every("compliant").alias("all_compliant"), F.count("*").alias("folds"))
