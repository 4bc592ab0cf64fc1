import pytest
from pyspark.sql import functions as F

from flowspark.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 < 3, 1).otherwise(0).alias("label")).cache()


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


def test_exact_class_proportions(rows):
    got = counts(split.stratified_split(rows, "label", "id", 0.7, 0.2, 0.1), "split", "label")
    assert got[("test", 1)] == 60 and got[("test", 0)] == 140
    assert sum(n for (part, _), n in got.items() if part == "val") in (100, 101)


def test_split_is_reproducible_and_disjoint(rows):
    first = split.two_way_split(rows, "label", "id", 0.25, 7)
    again = split.two_way_split(rows.repartition(5), "label", "id", 0.25, 7)
    assert sorted(first.collect()) == sorted(again.collect())
    other = split.two_way_split(rows, "label", "id", 0.25, 8)
    assert sorted(first.collect()) != sorted(other.collect())


def test_no_validation_part(rows):
    assert set(counts(split.stratified_split(rows, "label", "id", 0.8, 0.2, 0.0), "split")) == {("train",), ("test",)}


@pytest.mark.parametrize("sizes, text", [((0.8, 0.3, 0.0), "not to 1"), ((0.8, 0.0, 0.2), "Training and test")])
def test_bad_sizes(rows, sizes, text):
    with pytest.raises(ValueError, match=text):
        split.stratified_split(rows, "label", "id", *sizes)


def test_single_class_is_refused(rows):
    with pytest.raises(ValueError, match="one class"):
        split.stratified_split(rows.where("label = 1"), "label", "id")


def test_folds_are_even(rows):
    got = counts(split.stratified_folds(rows, "label", "id", 7), "fold", "label")
    for label in (0, 1):
        sizes = [n for (_, y), n in got.items() if y == label]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError, match="fewer rows"):
        split.stratified_folds(rows.limit(6), "label", "id", 5)


def test_inner_split_excludes_the_fold(rows):
    folded = split.stratified_folds(rows, "label", "id", 5)
    inner = split.inner_split(folded, "label", "id", 2, 0.7, 0.15, 42)
    assert inner.where("fold = 2").count() == 0
    assert set(counts(inner, "split")) == {("train",), ("val",)}


def test_undersample(rows):
    assert counts(split.undersample(rows, "label", "id"), "label") == {(0,): 300, (1,): 300}


def test_oversample_keeps_every_original(rows):
    out = split.oversample(rows, "label", "id")
    assert counts(out, "label") == {(0,): 700, (1,): 700}
    assert out.where("draw = 0").count() == 1000
    assert out.join(rows, ["id", "label"], "left_anti").count() == 0


def test_dense_ranks(rows):
    ranked = split.ranked_by_hash(rows, "label", "id", 1).collect()
    for label in (0, 1):
        ranks = sorted(r["_rank"] for r in ranked if r["label"] == label)
        assert ranks == list(range(1, len(ranks) + 1))


def test_balanced_weights(rows):
    assert split.class_weights(rows, "label") == {0: 1000 / 1400, 1: 1000 / 600}


def test_string_labels(spark, rows):
    named = rows.withColumn("label", F.when(F.col("label") == 1, "DDoS").otherwise("Benign"))
    assert counts(split.two_way_split(named, "label", "id", 0.1), "split", "label")[("test", "DDoS")] == 30


def test_split_plan_has_no_shuffle(rows):
    parts = split.stratified_split(rows, "label", "id")
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_smote_neighbours_are_exact(spark, monkeypatch):
    import numpy as np

    from flowspark.operators import smote

    monkeypatch.setattr(smote, "CELL_POINTS", 40)
    monkeypatch.setattr(smote, "QUERIES_PER_TASK", 30)
    rng = np.random.default_rng(0)
    x = np.round(rng.random((200, 3)), 2)
    x = np.concatenate([x, np.tile(x[:1], (60, 1)), x[1:4]])
    points, copies = np.unique(x, axis=0, return_counts=True)
    table = spark.createDataFrame(
        [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, copies))], smote.POINT
    )
    found = {r["_pid"]: np.array(r["neighbours"]) for r in smote.nearest_neighbours(table, table, 5).collect()}
    assert len(found) == len(points)
    for i, p in enumerate(points):
        others = np.delete(x, np.flatnonzero((x == p).all(axis=1))[0], axis=0)
        nearest = np.sort(((others - p) ** 2).sum(axis=1))[:5]
        assert np.allclose(np.sort(((found[i] - p) ** 2).sum(axis=1)), nearest)


def test_smote_finds_touched_cells_from_the_top_down(monkeypatch):
    import numpy as np

    from flowspark.operators import smote

    rng = np.random.default_rng(1)
    x = np.round(rng.random((3000, 3)), 2)
    nodes = smote._split_cells(x, 150)
    cell = smote._cell_of(nodes, x)
    low, high = (np.array([f(x[cell == c], axis=0) if (cell == c).any() else np.full(3, np.inf) for c in range(len(nodes))]) for f in (np.min, np.max))
    limit = rng.random(3000) ** 4
    limit[5] = np.inf
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
    gap[:, np.isinf(low).any(axis=1)] = np.inf
    with np.errstate(invalid="ignore"):
        expected = {(r, c) for r, c in zip(*np.nonzero((gap**2).sum(axis=2) <= limit[:, None])) if np.isfinite(low[c]).all()}
    monkeypatch.setattr(smote, "MAX_FRONTIER", 4000)
    rows, cells = smote._touched([np.array(part) for part in zip(*nodes)], low, high, x, limit)
    assert {(r, c) for r, c in zip(rows.tolist(), cells.tolist()) if np.isfinite(low[c]).all()} == expected
    assert len(rows) == len(set(zip(rows.tolist(), cells.tolist())))


def test_smote_distances_far_from_the_origin_are_exact():
    import numpy as np

    from flowspark.operators import smote

    # Neighbours 1e-3 apart, clusters 1e6 apart: a product of matrices alone would round them away.
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 1e-3 * rng.random((60, 2)) for c in (-1e6, 0.0, 1e6)])
    ids, ones = np.arange(len(x)), np.ones(len(x), np.int64)
    squared = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    limit = smote._bounds(ids, x, ids, x, ones, 5)
    assert (limit >= np.sort(squared, axis=1)[:, 5]).all()
    own, hit, found = smote._within(x, x, limit, 12)
    for i in range(len(x)):
        assert np.array_equal(np.sort(found[own == i])[:6], np.sort(squared[i])[:6])


def test_smote_balances_between_minority_rows(spark):
    from flowspark.operators.split import balance

    rows = [(i, 1, float(i % 5), 1.0) for i in range(12)] + [(100 + i, 0, 50.0, 9.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    out = balance(df, "label", "id", "smote", ["a", "b"]).cache()
    assert counts(out, "label") == {(0,): 40, (1,): 40}
    made = out.where("synthetic").collect()
    assert len(made) == 28 and all(0.0 <= r.a <= 4.0 and r.b == 1.0 for r in made)
    with pytest.raises(ValueError, match="no balancing"):
        balance(df, "label", "id", "other")


def test_cuts_descend_into_full_prefixes(rows, monkeypatch):
    expected = split.two_way_split(rows, "label", "id", 0.25, 7).collect()
    monkeypatch.setattr(split, "PREFIX_DIGITS", 1)
    monkeypatch.setattr(split, "RANKED_ROWS", 2)
    assert sorted(split.two_way_split(rows, "label", "id", 0.25, 7).collect()) == sorted(expected)
