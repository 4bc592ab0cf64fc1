import pytest

from flowspark.operators import drift, governance, metrics

# TN, FP, FN, TP and the published accuracy, precision, recall, f1, FPR.
PUBLISHED = [
    ((801217, 4548, 16064, 196207), (0.9798, 0.9773, 0.9243, 0.9501, 0.0056)),
    ((804044, 1721, 17692, 194579), (0.9809, 0.9912, 0.9167, 0.9525, 0.0021)),
    ((602421, 1903, 12907, 146296), (0.9806, 0.9872, 0.9189, 0.9518, 0.0031)),
    ((601868, 2456, 12563, 146640), (0.9803, 0.9835, 0.9211, 0.9513, 0.0041)),
    ((601732, 2592, 12504, 146699), (0.9802, 0.9826, 0.9215, 0.9511, 0.0043)),
    ((602200, 2124, 12452, 146751), (0.9809, 0.9857, 0.9218, 0.9527, 0.0035)),
    ((2123467, 147853, 529761, 26795), (0.7604, 0.1534, 0.0481, 0.0733, 0.0651)),
]


@pytest.mark.parametrize("cells, expected", PUBLISHED)
def test_published_rates(spark, cells, expected):
    row = metrics.rates(spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")).first()
    got = (row.accuracy, row.precision, row.recall, row.f1, row.fpr)
    assert [round(v, 4) for v in got] == list(expected)


def test_empty_denominators_are_zero(spark):
    row = metrics.rates(spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert row.precision == row.recall == row.fpr == row.f1 == 0.0


def test_string_labels(spark):
    rows = [("Benign", "Benign", 0.1), ("Attack", "Attack", 0.9), ("Attack", "Benign", 0.4), ("Benign", "Benign", 0.2)]
    df = spark.createDataFrame(rows, "y string, z string, p double")
    row = metrics.binary_metrics(df, "y", "z", "p", positive="Attack").first()
    assert row.roc_auc == 1.0 and row.recall == 0.5 and row.fp == 0


def test_multiclass(spark):
    rows = [
        (0, 0, [0.9, 0.05, 0.05]), (1, 1, [0.1, 0.8, 0.1]), (2, 1, [0.1, 0.6, 0.3]),
        (0, 0, [0.8, 0.1, 0.1]), (1, 2, [0.2, 0.2, 0.6]), (2, 2, [0.1, 0.1, 0.8]),
    ]
    df = spark.createDataFrame(rows, "y int, z int, p array<double>")
    report = metrics.evaluate(df, "y", "z", [0, 1, 2], "p")
    assert report["confusion_matrix"].count() == 5
    row = report["metrics"].first()
    assert row.accuracy == pytest.approx(4 / 6)
    assert 0 <= row.roc_auc <= 1 and 0 <= row.pr_auc <= 1


def test_absent_class_keeps_its_row(spark):
    df = spark.createDataFrame([("a", "a")], "y string, z string")
    rows = {r["class"]: r for r in metrics.class_report(df, "y", "z", ["a", "b"]).collect()}
    assert rows["b"].support == 0 and rows["b"].f1 == 0.0
    assert rows["accuracy"].f1 == 1.0


def test_highest_compliant_threshold(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.3), (1, 0.7), (1, 0.9)], "y int, p double")
    threshold, table = metrics.select_threshold(df, "y", "p", [0.5, 0.4, 0.6, 0.5], 1.0, 0.0)
    assert threshold == 0.6 and table.count() == 3
    assert all(r.meets_targets for r in table.collect())
    assert metrics.select_threshold(df, "y", "p", [0.4], 1.0, 0.0, frozen=0.26)[0] == 0.26


def test_fallback_prefers_recall_then_fpr_then_threshold(spark):
    sweep = spark.createDataFrame(
        [(0.2, 0.9, 0.3, False), (0.3, 0.9, 0.2, False), (0.4, 0.9, 0.2, False), (0.5, 0.1, 0.0, False)],
        "threshold double, recall double, fpr double, meets_targets boolean",
    )
    assert metrics.choose_threshold(sweep).first().threshold == 0.4


@pytest.mark.parametrize("bad", [[], [0.0], [1.0], [0.5, 1.2]])
def test_candidates_must_be_probabilities(spark, bad):
    df = spark.createDataFrame([(0, 0.1)], "y int, p double")
    with pytest.raises(ValueError):
        metrics.threshold_sweep(df, "y", "p", bad)


def test_many_candidates_use_the_other_bucket_path(spark):
    df = spark.createDataFrame([(i % 2, i / 200) for i in range(200)], "y int, p double")
    points = [i / 200 for i in range(1, 200)]
    for r in metrics.threshold_sweep(df, "y", "p", points).collect():
        assert r.false_positives == sum(1 for i in range(0, 200, 2) if i / 200 >= r.threshold)


def brute_scores(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        reached = sum(p >= t for p in pos)
        ap += sum(p == t for p in pos) / len(pos) * reached / sum(p >= t for _, p in rows)
    return auc, ap


def test_ranking_across_buckets(spark, monkeypatch):
    import functools
    import random

    from flowspark.functions import sequence

    random.seed(5)
    rows = [(random.randint(0, 1), round(random.random() ** 3, 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    for size in (7, 3):
        small = functools.partial(sequence.quantile_edges, rows_per_bucket=size)
        monkeypatch.setattr(metrics, "quantile_edges", small)
        row = metrics.ranking_scores(df, "y", "p").first()
        assert (row.roc_auc, row.pr_auc) == pytest.approx(brute_scores(rows))
        full = {r.threshold: r for r in metrics.roc_points(df, "y", "p", drop_intermediate=False).collect()}
        kept = {r.threshold for r in metrics.roc_points(df, "y", "p").collect()}
        assert kept <= set(full) and None in kept
        order = sorted((t for t in full if t is not None), reverse=True)
        steps = [(sum(1 for y, p in rows if p == t and y == 1), sum(1 for y, p in rows if p == t and y == 0)) for t in order]
        expected = {t for i, t in enumerate(order) if i in (0, len(order) - 1) or steps[i] != steps[i + 1]}
        assert kept - {None} == expected


def test_single_class_has_no_area(spark):
    row = metrics.ranking_scores(spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double"), "y", "p").first()
    assert row.roc_auc is None and row.pr_auc == 1.0


def test_pr_curve_ends_at_one_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, p double")
    last = [r for r in metrics.pr_points(df, "y", "p").collect() if r.threshold is None]
    assert [(r.precision, r.recall) for r in last] == [(1.0, 0.0)]


def test_calibration_and_brier(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    assert drift.brier_score(df, "y", "p").first()[0] == pytest.approx(0.025)
    assert drift.calibration_table(df, "y", "p").count() > 0
    assert drift.calibration_summary(df, "y", "p").first().average_precision == 1.0
    with pytest.raises(ValueError, match="two bins"):
        drift.calibration_table(df, "y", "p", 1)
    with pytest.raises(ValueError):
        drift.calibration_table(df.where("y = 1"), "y", "p")


def test_values_outside_the_edges_count(spark):
    baseline = drift.drift_baseline(spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.3)], "feature double"), ["feature"])
    fresh = spark.createDataFrame([(v,) for v in (9.0, 9.1, 9.2, 9.3)], "feature double")
    row = drift.drift_report(fresh, baseline, 0.01).first()
    assert row.finite_rows == 4 and row.drift_detected and row.psi > 0.01
    assert drift.drift_summary(drift.drift_report(fresh, baseline, 0.01)).first().requires_review


def test_same_data_has_no_drift(spark):
    df = spark.createDataFrame([(float(i % 13), 5.0) for i in range(100)], "a double, c double")
    report = drift.drift_report(df, drift.drift_baseline(df, ["a", "c"])).collect()
    assert all(r.psi == pytest.approx(0.0) and not r.drift_detected for r in report)
    state = drift.drift_state(drift.drift_summary(drift.drift_report(df, drift.drift_baseline(df, ["a"])))).first()
    assert state.state == "healthy"


def test_drift_of_missing_and_empty_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    baseline = drift.drift_baseline(df, ["a", "b"])
    rows = {r.feature: r for r in drift.drift_report(df.drop("b"), baseline).collect()}
    assert rows["b"].status == "missing" and rows["b"].psi is None
    empty = drift.drift_report(df.where("a > 9"), baseline).collect()
    assert all(r.finite_rows == 0 for r in empty)
    with pytest.raises(ValueError, match="above 0"):
        drift.drift_report(df, baseline, 0)
    with pytest.raises(ValueError, match="not there"):
        drift.drift_baseline(df, ["z"])
    with pytest.raises(ValueError, match="not one value"):
        drift.drift_baseline(spark.createDataFrame([(float("inf"),)], "a double"), ["a"])


def test_gate(spark):
    good = spark.createDataFrame([(0.93, 0.004)], "recall double, fpr double")
    poor = spark.createDataFrame([(0.90, 0.004)], "recall double, fpr double")
    digest = "a" * 64
    assert governance.require_gate(governance.quality_gate(good, good, 0.92, 0.005, 0.26, [0.26]), digest)["passed"]
    with pytest.raises(ValueError, match="test_recall"):
        governance.require_gate(governance.quality_gate(good, poor, 0.92, 0.005, 0.26, [0.26]), digest)
    with pytest.raises(ValueError, match="threshold_is_candidate"):
        governance.require_gate(governance.quality_gate(good, good, 0.92, 0.005, 0.26, [0.3]), digest)
    with pytest.raises(ValueError, match="hash"):
        governance.require_gate(governance.quality_gate(good, good, 0.92, 0.005, 0.26, [0.26]), "xyz")
    with pytest.raises(ValueError, match="validation_choice_complied"):
        governance.require_gate(governance.quality_gate(good, good, 0.92, 0.005, 0.26, [0.26], complied=False), digest)
    assert governance.require_gate(governance.quality_gate(good, good, 0.92, 0.005, 0.26, [0.26], complied=True), digest)["passed"]
    gap = spark.createDataFrame([(None, 0.004)], "recall double, fpr double")
    with pytest.raises(ValueError, match="test_recall is missing"):
        governance.require_gate(governance.quality_gate(good, gap, 0.92, 0.005, 0.26, [0.26]), digest)


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    assert governance.fingerprint(df).first() == governance.fingerprint(df.repartition(7).orderBy("v")).first()
    assert governance.fingerprint(df).first() != governance.fingerprint(df.where("id < 99")).first()


def test_quantiles_of_groups_do_not_deal_rows_by_their_group(spark, monkeypatch):
    from flowspark.functions import quantiles

    plans, solve = [], quantiles._solve

    def spy(sizes, brackets, listed, code, key_type):
        plans.append(code(brackets)._jdf.queryExecution().executedPlan().toString())
        return solve(sizes, brackets, listed, code, key_type)

    monkeypatch.setattr(quantiles, "_solve", spy)
    df = spark.range(1000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(id AS DOUBLE) AS v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles.group_quantiles(df, "g", "v", [0.5])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {"0": {0.5: 499.0}, "1": {0.5: 500.0}}
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
