"""Trees against brute force, and their two ways of growing against each other."""

import numpy as np
import pytest

from flowspark.operators import kernels, models, trees


def slow_best(codes, g, h, count, rules):
    """Best split over all features and cuts, by summing rows."""
    best = (0.0, -1, 0)
    for f in range(len(codes)):
        for cut in range(codes[f].max()):
            low = codes[f] <= cut
            if not low.any() or low.all() or h[low].sum() < rules.least_weight or h[~low].sum() < rules.least_weight:
                continue
            if count[low].sum() < rules.least_rows or count[~low].sum() < rules.least_rows:
                continue
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + rules.l2)
            gain = part(low) + part(~low) - g.sum() ** 2 / (h.sum() + rules.l2)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("rules", [trees.Rules(1.0, 0.0, 0, 0), trees.Rules(0.5, 3.0, 0, 0), trees.Rules(0.0, 0.0, 4, 0)])
def test_splits_equal_brute_force(rules):
    rng = np.random.default_rng(4)
    for _ in range(30):
        rows = rng.integers(2, 60)
        codes = rng.integers(0, 6, (3, rows)).astype(np.uint8)
        g, h, count = rng.normal(size=rows), rng.random(rows) + 0.1, rng.integers(1, 3, rows).astype(float)
        tree, at = trees.grow(codes, [6, 6, 6], g, h, count, 1, rules, lambda a, b: -a / (b + rules.l2))
        gain, feature, cut = slow_best(codes, g, h, count, rules)
        if feature < 0:
            assert len(tree.feature) == 1
            continue
        assert tree.gain[0] == pytest.approx(gain) and (tree.feature[0], len(tree.feature)) == (feature, 3)
        low = codes[feature] <= tree.cut[0]
        assert (low == (codes[feature] <= cut)).all() and (at == np.where(low, 1, 2)).all()
        assert tree.value[1] == pytest.approx(-g[low].sum() / (h[low].sum() + rules.l2))


def test_cells_are_the_same_dense_and_sorted():
    rng = np.random.default_rng(2)
    key, g, h = rng.integers(0, 50, 80), rng.normal(size=80), rng.random(80) + 0.1
    dense, sparse = trees._cells(key, [g, h, h], 50), trees._cells(key, [g, h, h], 10**6)
    assert (dense[0] == sparse[0]).all() and all(np.allclose(a, b) for a, b in zip(dense[1], sparse[1]))


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3)).round(2)
    label = ((np.sin(2 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=3000)) > 0).astype(int)
    rows = [(k, *map(float, r), int(y)) for k, (r, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(3).cache()


def scores(df, model):
    return {r.id: r.probability for r in models.attack_probability(df, model).select("id", "probability").collect()}


def test_boosting_by_levels_equals_boosting_at_hand(wavy, monkeypatch):
    p = {"n_estimators": 23, "max_depth": 4, "reg_lambda": 2.0, "min_child_weight": 2.0, "random_state": 7}
    at_hand = scores(wavy, models.train(wavy, ["a", "b", "c"], "gbt", p))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100)
    by_levels = scores(wavy, models.train(wavy, ["a", "b", "c"], "gbt", p))
    apart = np.array([abs(at_hand[k] - by_levels[k]) for k in at_hand])
    assert np.median(apart) < 1e-9 and (apart < 1e-6).mean() > 0.98  # sums in another order may turn a tie


def test_forest_with_split_tops(wavy, monkeypatch):
    p = {"n_estimators": 20, "max_depth": 8}
    right = {r.id: r.label for r in wavy.select("id", "label").collect()}
    hits = []
    for rows in (1 << 20, 700):
        monkeypatch.setattr(trees, "LOCAL_ROWS", rows)
        model = models.train(wavy, ["a", "b", "c"], "random_forest", p)
        assert len(model.fitted.roots) == 20 and 3 < model.fitted.depth <= 8
        found = scores(wavy, model)
        hits.append(np.mean([(found[k] >= 0.5) == right[k] for k in right]))
        share = trees.importances(model.fitted, 3, False)
        assert share.sum() == pytest.approx(1) and share[2] < min(share[:2])
    assert min(hits) > 0.9 and abs(hits[0] - hits[1]) < 0.02


def test_l2_and_child_weight_shrink_trees(wavy):
    small = {"n_estimators": 1, "max_depth": 3, "learning_rate": 1.0, "subsample": 1.0, "colsample_bytree": 1.0}
    free, tied, stout = (models.train(wavy, ["a", "b"], "gbt", {**small, **x}).fitted for x in ({"reg_lambda": 0.0}, {"reg_lambda": 500.0}, {"min_child_weight": 200.0}))
    assert np.abs(tied.value).max() < 0.7 * np.abs(free.value).max()
    leaves = lambda m: int((m.low == np.arange(len(m.low))).sum())
    assert leaves(stout) < leaves(free) and stout.weight[stout.low == np.arange(len(stout.low))].min() >= 200


def test_missing_values_and_constant_columns(spark):
    rows = [(k, float("nan") if k % 3 == 0 else float(k % 3), 5.0, int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = models.train(df, ["a", "b"], "gbt", {"n_estimators": 30, "subsample": 1.0, "colsample_bytree": 1.0})
    found = scores(df, model)
    assert all((found[k] > 0.5) == bool(y) for k, _, _, y in rows)


def test_radial_machine_separates_a_ring(spark):
    rng = np.random.default_rng(3)
    angle, radius = rng.uniform(0, 2 * np.pi, 1200), np.where(np.arange(1200) % 2, 1.0, 3.0) + rng.normal(0, 0.2, 1200)
    rows = [(k, float(r * np.cos(a)), float(r * np.sin(a)), k % 2) for k, (a, r) in enumerate(zip(angle, radius))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    assert models.accuracy(df, models.train(df, ["a", "b"], "svm")) > 0.99
    assert models.accuracy(df, models.train(df, ["a", "b"], "svm", {"kernel": "linear"})) < 0.7


def test_random_cosines_stand_for_the_kernel():
    rng = np.random.default_rng(1)
    x, gamma, errors = rng.normal(size=(60, 5)), 0.2, []
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    for components in (128, 512, 2048):
        z = kernels.mapped(x, np.zeros(5), np.ones(5), np.sqrt(2 * gamma) * rng.normal(size=(5, components)), rng.uniform(0, 2 * np.pi, components))
        errors.append(np.sqrt(np.mean((z @ z.T - exact) ** 2)))
    assert all(e < 1.5 / np.sqrt(c) for e, c in zip(errors, (128, 512, 2048)))


def test_equal_rows_are_one_row_with_a_count(wavy):
    twice = wavy.unionByName(wavy).unionByName(wavy.where("id % 2 = 0"))
    edges = trees.fit_bins(wavy, ["a", "b", "c"])
    once, more = (trees.binned(df, ["a", "b", "c"], "label", edges) for df in (wavy, twice))
    assert sum(r.n for r in more.collect()) == sum(r.n for r in once.collect())
    assert trees._class_counts(more)[0] == {(0, y): n for y, n in ((r.label, r["count"]) for r in twice.groupBy("label").count().collect())}
    p = models.resolve_parameters("gbt", {"n_estimators": 5, "subsample": 1.0, "colsample_bytree": 1.0})
    weights = [m.weight[m.roots[0]] for m in (trees.fit_boosted(b, edges, {0: (p, 0)})[0] for b in (once, more))]
    zeros, ones = (twice.where(f"label = {y}").count() for y in (0, 1))
    assert weights[1] > 2 * weights[0] and weights[1] == pytest.approx(zeros * ones / (zeros + ones))


def test_a_written_forest_scores_as_one_in_memory(wavy, monkeypatch):
    p = {"n_estimators": 9, "max_depth": 8}
    held = models.train(wavy, ["a", "b", "c"], "random_forest", p)
    monkeypatch.setattr(trees, "HELD_NODES", 10)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 1 << 12)
    written = models.train(wavy, ["a", "b", "c"], "random_forest", p)
    assert isinstance(written.fitted, trees.Stored)
    a, b = scores(wavy, held), scores(wavy, written)
    assert len(a) == len(b) == 3000 and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert np.allclose(trees.importances(held.fitted, 3, False), trees.importances(written.fitted, 3, False))


def test_a_forest_of_many_nodes_stays_off_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(y)) for a, b, y in zip(rng.random(8000), rng.random(8000), rng.integers(0, 2, 8000))]
    noise = spark.createDataFrame(rows, "a double, b double, label int")
    model = models.train(noise, ["a", "b"], "random_forest", {"n_estimators": 150})
    assert isinstance(model.fitted, trees.Stored) and 2**18 < model.fitted.nodes.count() < 2**20


def test_left_out_rows_are_scored_with_their_numbers(wavy, monkeypatch):
    twice = wavy.unionByName(wavy.withColumn("id", wavy.id + 5000))
    _, report = models.randomized_search(twice, ["a", "b", "c"], "label", "id", "random_forest", iterations=1, space={"n_estimators": [5], "max_depth": [6]})
    monkeypatch.setattr(trees, "HELD_NODES", 10)
    _, again = models.randomized_search(twice, ["a", "b", "c"], "label", "id", "random_forest", iterations=1, space={"n_estimators": [5], "max_depth": [6]})
    a, b = (r.first().mean_average_precision for r in (report, again))
    assert 0.85 < a < 1 and a == pytest.approx(b, abs=1e-9)


def test_a_machine_sees_each_distinct_row_once(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "cast(id % 10 as double) AS a", "cast(id % 7 as double) AS b", "cast(id % 10 > 4 as int) AS label")
    seen = []
    monkeypatch.setattr(kernels, "materialize", lambda table, name: seen.append((name, table.count())) or table.cache())
    model = models.train(df, ["a", "b"], "svm")
    assert seen == [("machine-rows", 70), ("margins", 70)] and models.accuracy(df, model) == 1.0


def test_a_written_forest_is_saved_and_loaded(wavy, monkeypatch, tmp_path):
    from flowspark.operators.scale import fit_scaler
    from flowspark.plans.artifact import Artifact, load_artifact, save_artifact

    monkeypatch.setattr(trees, "HELD_NODES", 10)
    model = models.train(wavy, ["a", "b", "c"], "random_forest", {"n_estimators": 3, "max_depth": 4})
    artifact = Artifact(model, fit_scaler(wavy, ["a", "b", "c"]), ("a", "b", "c"), 0.5, "v")
    again = load_artifact(wavy.sparkSession, save_artifact(wavy.sparkSession, artifact, str(tmp_path / "run"))).model
    assert isinstance(again.fitted, trees.Stored) and scores(wavy, again) == pytest.approx(scores(wavy, model))


def _coded(rows=4000, seed=3):
    rng = np.random.default_rng(seed)
    bins = [40, 256, 9, 3]
    codes = np.stack([rng.integers(0, b, rows).astype(np.uint8) for b in bins])
    label = (rng.random(rows) < 0.1 + 0.5 * (codes[0] > 20) * (codes[2] > 4) + 0.001 * codes[1]).astype(np.uint8)
    return bins, trees.Block(codes, label, np.zeros(rows, np.uint8), rng.integers(1, 4, rows).astype(np.uint32))


@pytest.mark.parametrize("depth", [1, 5, 8])
def test_smaller_children_give_the_same_boosted_trees(monkeypatch, depth):
    bins, block = _coded()
    p = models.check_parameters("gbt", {"n_estimators": 5, "max_depth": depth})
    summed = []
    whole = trees._grow_boosted
    monkeypatch.setattr(trees, "_grow_boosted", lambda *a: summed.append(1) or whole(*a))
    quick = trees.boost([(0, block)], bins, p, -1.0)
    assert len(summed) == 5
    monkeypatch.setattr(trees, "MOST_SUMS", 0)
    for a, b in zip(quick, trees.boost([(0, block)], bins, p, -1.0)):
        assert a.feature == b.feature and a.cut == b.cut and a.low == b.low and a.high == b.high
        assert np.allclose(a.value, b.value) and np.allclose(a.weight, b.weight)
    assert len(summed) == 5


@pytest.mark.parametrize("depth", [5, 9])
def test_scorer_scores_as_the_walk_does(depth):
    bins, block = _coded()
    p = models.check_parameters("gbt", {"n_estimators": 5, "max_depth": depth})
    grown = trees.boost([(0, block)], bins, p, -1.0)
    edges = [np.arange(b - 1.0) for b in bins]
    model = trees._ensemble([trees._node_rows(0, t, range(len(x.feature)), x) for t, x in enumerate(grown)], edges, -1.0)[0]
    scorer = trees.Scorer(model)
    assert (len(scorer.walked) == 0) == (depth == 5)
    x = block.codes.T.astype(float)
    x[::7, 1], x[3, 0], x[4, 0] = np.nan, np.inf, -np.inf
    for rows in (x[:1000], x, x[::-1]):
        assert np.allclose(scorer.total(rows), model.total(rows), rtol=0, atol=1e-12)
    # Rows whose codes were met before are not walked again.
    scorer.model = None
    assert depth == 5 or len(scorer.total(x)) == len(x)


def test_repeated_rows_do_not_deepen_the_top_of_a_forest(spark, monkeypatch):
    from pyspark import RDD

    rounds, summed = [], RDD.reduceByKey
    monkeypatch.setattr(RDD, "reduceByKey", lambda *a, **k: rounds.append(1) or summed(*a, **k))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 30)
    cells = [(float(a), float(b), int(a > 2 and b > 4)) for a in range(6) for b in range(8)]
    df = spark.createDataFrame(cells * 200, "a double, b double, label int")
    model = models.train(df, ["a", "b"], "random_forest", {"n_estimators": 4})
    # 48 distinct rows are halved once or twice; each is drawn 200 times, so counting draws would go on to single cells.
    assert len(rounds) <= 3
    assert models.accuracy(df, model) == 1.0
