import hashlib
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark import session
from flowspark.operators import clean, models, permutation
from flowspark.operators.scale import apply_scaler, fit_scaler
from flowspark.plans import scoring, training
from flowspark.plans.artifact import load_artifact
from flowspark.plans.training import Settings

NAMES = ["flow_bytes", "packet_count"]
SMALL = {"gbt": {"n_estimators": 3, "max_depth": 2}, "random_forest": {"n_estimators": 4, "max_depth": 3}, "svm": {"max_iter": 8}}


@pytest.fixture(scope="module")
def data(spark):
    random.seed(11)
    rows = [
        (i, i % 2 + random.gauss(0, 0.1), 3.0 * (i % 2) + random.gauss(0, 1.5), random.random(), i % 2) for i in range(200)
    ]
    return spark.createDataFrame(rows, "id int, flow_bytes double, packet_count double, noise double, label int").cache()


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_model_types_learn(data, kind):
    model = models.train(data, NAMES, kind, SMALL[kind])
    scored = models.predict(data, model)
    assert scored.columns == [*data.columns, "probability", "prediction"]
    assert scored.where("probability < 0 OR probability > 1").count() == 0
    assert models.accuracy(data, model) > 0.9


def test_unknown_parameters(data):
    with pytest.raises(TypeError, match="has no parameters"):
        models.train(data, NAMES, "random_forest", {"scale_pos_weight": 1.1})
    with pytest.raises(ValueError, match="A model is one of"):
        models.train(data, NAMES, "other")
    with pytest.raises(ValueError, match="kernel"):
        models.train(data, NAMES, "svm", {"kernel": "poly"})
    with pytest.raises(ValueError, match="max_depth"):
        models.train(data, NAMES, "gbt", {"max_depth": 31})


def test_training_contract(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.train(spark.createDataFrame([(0.0, 1), (1.0, 1)], "a double, label int"), ["a"])
    with pytest.raises(ValueError, match="0 .benign. and 1 .attack."):
        models.train(spark.createDataFrame([(0.0, 1), (1.0, 2)], "a double, label int"), ["a"])


def test_positive_weight_raises_probabilities(data):
    noisy = data.withColumn("label", F.when(F.col("id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    means = [
        models.predict(noisy, models.train(noisy, ["noise"], "gbt", {**SMALL["gbt"], "scale_pos_weight": w})).agg(F.avg("probability")).first()[0]
        for w in (1.0, 5.0)
    ]
    assert means[1] > means[0] + 0.2


def test_importances(data):
    model = models.train(data, [*NAMES, "noise"], "random_forest", SMALL["random_forest"])
    rows = {r.feature: r.importance for r in models.feature_importance(data, model).collect()}
    assert sum(rows.values()) == pytest.approx(1.0) and rows["noise"] < rows["flow_bytes"]
    with pytest.raises(ValueError):
        models.feature_importance(data, models.train(data, NAMES, "svm", SMALL["svm"]))


def test_permutation_importance(data):
    scaled = apply_scaler(data, fit_scaler(data, [*NAMES, "noise"]))
    model = models.train(scaled, [*NAMES, "noise"], "gbt", SMALL["gbt"])
    rows = models.permutation_importance(scaled, model, "label", "id", repeats=2).collect()
    assert {r.feature for r in rows} == {*NAMES, "noise"}
    assert rows[0].feature == "flow_bytes" and rows[0].importance_mean > 0.2
    with pytest.raises(ValueError, match="repeats"):
        models.permutation_importance(scaled, model, "label", "id", repeats=0)


def permuted_by_hand(rows, model, repeats, seed=42):
    """Losses of all features and repeats, row by row; ``rows``: (id, label, values)."""
    def precision(scored):
        hits, seen, area = 0, 0, 0.0
        for s in sorted({s for s, _ in scored}, reverse=True):
            own = [y for x, y in scored if x == s]
            hits, seen = hits + sum(own), seen + len(own)
            area += sum(own) * hits / seen
        return area / hits

    def scores(values):
        total = model.fitted.total(np.array(values))
        return (1 / (1 + np.exp(-model.fitted.base - total)) if model.kind == "gbt" else total / len(model.fitted.roots)).tolist()

    base, losses = precision(list(zip(scores([v for _, _, v in rows]), [y for _, y, _ in rows]))), {}
    for k in range(repeats):
        order = sorted(rows, key=lambda r: hashlib.md5(f"{seed + k}|{r[0]}".encode()).hexdigest())
        donors = [*order[1:], order[0]]
        for f, name in enumerate(model.features):
            changed = [[*a[2][:f], b[2][f], *a[2][f + 1 :]] for a, b in zip(order, donors)]
            losses.setdefault(name, []).append(base - precision(list(zip(scores(changed), [r[1] for r in order]))))
    return base, losses


@pytest.mark.parametrize("kind", ["gbt", "random_forest"])
def test_permuted_rows_are_packed_and_leave_nothing(data, kind, monkeypatch):
    """Ranges of a few rows, scores cut in many places, a feature with gaps; nothing stays on disk, nothing wide is written."""
    names = [*NAMES, "noise"]
    df = data.withColumn("noise", F.when(F.col("id") % 5 > 0, F.col("noise")))
    model = models.train(df, names, kind, SMALL[kind])
    written = []
    monkeypatch.setattr(permutation, "RANGE_ROWS", 30)
    monkeypatch.setattr(permutation, "CHUNK_ROWS", 16)
    monkeypatch.setattr(permutation, "materialize", lambda df, name, keep=permutation.materialize: written.append(keep(df, name)) or written[-1])
    found = {r.feature: r for r in models.permutation_importance(df, model, "label", "id", repeats=3).collect()}
    rows = [(r.id, r.label, [np.nan if r[n] is None else float(r[n]) for n in names]) for r in df.collect()]
    base, losses = permuted_by_hand(rows, model, 3)
    for name, own in losses.items():
        assert found[name].importance_mean == pytest.approx(np.mean(own), abs=1e-12)
        assert found[name].importance_std == pytest.approx(np.std(own), abs=1e-12)
        assert found[name].baseline_average_precision == pytest.approx(base, abs=1e-12)
    assert written[0].columns == ["_id", "_y", "_score", "w0"]
    assert not any(os.path.exists(f.removeprefix("file:")) for t in written for f in t.inputFiles())


def test_written_tables_leave_no_shuffle_files(data, spark):
    """Of several writes at once; the session's own setting is as before."""
    keep = spark.conf.get(session.CLEANUP, None)
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    blocks = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = blocks()
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda k: session.materialize(data.repartition(3, "id").withColumn("k", F.lit(k)), "shuffled"), range(8)))
    until = time.time() + 20
    while (left := blocks() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and [t.count() for t in tables] == [200] * 8
    assert spark.conf.get(session.CLEANUP, None) == keep


def test_donors_are_one_cycle(data):
    donated = models.shuffled_donor(data, ["id"], "id", 3)
    follows = {r.id: r.d for r in donated.select("id", F.col("_donor.id").alias("d")).collect()}
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = follows[at]
    assert len(seen) == len(follows) == 200
    other = {r.id: r.d for r in models.shuffled_donor(data, ["id"], "id", 4).select("id", F.col("_donor.id").alias("d")).collect()}
    assert sum(follows[k] != other[k] for k in follows) > 180


def test_search_candidates_are_distinct_and_bounded():
    space = {"max_depth": [2, 3], "subsample": [0.7, 0.8]}
    found = models.sample_parameters("gbt", {"n_estimators": 3}, 99, 1, space)
    assert len({str(f) for f in found}) == 4
    assert len(models.sample_parameters("random_forest", {}, 10, 42)) == 10
    with pytest.raises(ValueError):
        models.sample_parameters("svm", {}, 2, 42)


def test_randomized_search(data):
    best, report = models.randomized_search(
        data, NAMES, "label", "id", "random_forest", {"n_estimators": 2}, 2, 2,
        space={"max_depth": [2, 3], "min_samples_leaf": [1, 2]},
    )
    rows = report.collect()
    assert len(rows) == 2 and "n_estimators" in best
    assert rows[0].mean_average_precision >= rows[1].mean_average_precision


def test_pipeline_artifact_and_scoring(spark, data, tmp_path):
    output = str(tmp_path / "run")
    settings = Settings(kind="random_forest", parameters=SMALL["random_forest"], n_features=2, min_recall=0.5, max_fpr=1.0)
    artifact, reports = training.train_pipeline(
        data, [*NAMES, "noise"], "label", "id", settings, "run_1", output
    )
    assert set(artifact.features) <= {*NAMES, "noise"} and len(artifact.features) == 2
    assert reports["metrics"].first().recall > 0.8
    sizes = [spark.read.parquet(f"{output}/split_{p}").count() for p in ("train", "val", "test")]
    assert sum(sizes) == 200 and sizes[2] == 30
    with pytest.raises(FileExistsError):
        training.train_pipeline(data, NAMES, "label", "id", settings, "run_1", output)

    loaded = load_artifact(spark, output)
    assert loaded.threshold == artifact.threshold and loaded.features == artifact.features
    assert loaded.run == artifact.run and sum(loaded.run["rows"].values()) == 200
    assert loaded.run["parameters"]["n_estimators"] == 4 and loaded.run["validation"]["recall"] > 0.5
    extra = data.withColumn("unused", F.lit("x"))
    scored = scoring.predict_table(extra, loaded)
    assert scored.columns == ["prediction", "probability"] and scored.count() == 200
    assert scoring.predict_table(extra, loaded, probabilities=False).columns == ["prediction"]
    with pytest.raises(ValueError, match="missing required"):
        scoring.predict_table(data.drop("flow_bytes"), loaded)

    for gap in (None, float("nan"), float("inf")):
        holed = data.limit(3).withColumn("flow_bytes", F.lit(gap).cast("double"))
        with pytest.raises(Exception, match="missing or infinite"):
            scoring.predict_table(holed, loaded).collect()
        with pytest.raises(ValueError, match="missing or infinite"):
            training.evaluate_frozen(holed, loaded, "label")

    report = training.evaluate_frozen(data, loaded, "label", expected_threshold=artifact.threshold)
    assert {"metrics", "calibration", "drift", "roc_curve"} <= set(report)
    assert report["drift"].where("status = 'ok'").count() == 2
    identity = report["identity"].first()
    assert (identity.model_version, identity.rows) == ("run_1", 200) and len(identity.model_sha256) == 64
    with pytest.raises(ValueError, match="another threshold"):
        training.evaluate_frozen(data, loaded, "label", expected_threshold=0.123)
    with pytest.raises(FileNotFoundError):
        load_artifact(spark, str(tmp_path / "nowhere"))

    csv = [str(tmp_path / f"{n}.csv") for n in ("one", "two")]
    for path in csv:
        data.limit(20).toPandas().to_csv(path, index=False)
    results = scoring.batch_predict(spark, loaded, csv, str(tmp_path / "batch"))
    assert {r["input"]: r["count"] for r in results.groupBy("input").count().collect()} == {"one": 20, "two": 20}
    assert spark.read.parquet(str(tmp_path / "batch")).count() == 40


def test_frozen_threshold_wins(data):
    settings = Settings(
        kind="random_forest", parameters=SMALL["random_forest"], n_features=2, frozen_threshold=0.26, fixed_features=NAMES
    )
    artifact, _ = training.train_pipeline(data, NAMES, "label", "id", settings)
    assert artifact.threshold == 0.26 and artifact.features == tuple(NAMES)


def test_nested_cross_validation(data):
    settings = Settings(
        kind="random_forest", parameters=SMALL["random_forest"], n_features=2, candidates=[0.4, 0.5, 0.6], min_recall=0.5, max_fpr=1.0
    )
    report = training.cross_validate(data, NAMES, "label", "id", settings, folds=2)
    assert report["out_of_fold_predictions"].count() == 200
    assert report["fold_metrics"].count() == 2
    assert {"recall", "fpr", "roc_auc"} <= {r.metric for r in report["summary"].collect()}
    assert {r.threshold for r in report["fixed_threshold_fold_metrics"].collect()} == {0.5}
    assert sum(r.sample_fraction for r in report["error_summary"].collect()) == pytest.approx(1.0)
    assert {r.selection_frequency for r in report["feature_importance_summary"].collect()} <= {0.5, 1.0}


def test_holdout_is_created_once(spark, data, tmp_path):
    output = str(tmp_path / "final")
    manifest = training.create_holdout(data, "label", "id", output)
    assert manifest["development_rows"] + manifest["final_holdout_rows"] == 200
    assert manifest["final_holdout_rows"] == 30
    with pytest.raises(FileExistsError, match="Already there"):
        training.create_holdout(data, "label", "id", output)
    with pytest.raises(ValueError):
        training.create_holdout(data, "label", "id", str(tmp_path / "other"), size=1.0)


def test_preparation_learns_on_training_rows(data):
    train, test = training.prepare_for_training(data, "label", "id", [*NAMES, "noise"])
    assert test.count() == 40
    assert train.agg(F.min("noise")).first()[0] == 0.0 and train.agg(F.max("noise")).first()[0] == 1.0
    assert train.columns == test.columns


def test_folds_leave_only_their_scores(data, monkeypatch):
    """Unused columns are not written; a fold's tables go when it is done; large folds run one after the other."""
    settings = Settings(kind="gbt", parameters=SMALL["gbt"], min_recall=0.5, max_fpr=1.0)
    written = []

    def keep(df, name, write=training.materialize):
        written.append((name, write(df, name)))
        return written[-1][1]

    monkeypatch.setattr(training, "materialize", keep)
    monkeypatch.setattr(clean, "materialize", keep)
    wide = data.withColumn("unused", F.lit("x" * 50))
    beside = training.cross_validate(wide, NAMES, "label", "id", settings, folds=2)["fold_metrics"].collect()
    assert all("unused" not in t.columns for _, t in written)
    left = {name for name, t in written if any(os.path.exists(f.removeprefix("file:")) for f in t.inputFiles())}
    assert {"folds", "cleaned", "train_features"} <= {name for name, _ in written} - left and "outer_scores" in left
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 1)
    busy = []
    monkeypatch.setattr(training, "ThreadPoolExecutor", lambda n, make=ThreadPoolExecutor: busy.append(n) or make(n))
    assert training.cross_validate(wide, NAMES, "label", "id", settings, folds=2)["fold_metrics"].collect() == beside and busy == [1]
