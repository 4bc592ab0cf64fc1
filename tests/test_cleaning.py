import math
import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions.expr import edges_passed, finite, normalise_header, to_number
from flowspark.functions.quantiles import column_quantiles, group_quantile_table, group_quantiles
from flowspark.functions.sequence import with_sequence
from flowspark.operators import clean, features, labels, neighbours, scale, selection


def test_lenient_numbers(spark):
    texts = ["1", " 2.5 ", "1e3", "-7", "", "abc", "Infinity", "-inf", "NaN", "1d", "2f", "0x1p3", None, "\t4\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [1.0, 2.5, 1000.0, -7.0] + [None] * 9 + [4.0]


def test_finite_guard(spark):
    values = [1.0, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(finite(F.col("v")).alias("v")).collect()
    assert [r.v for r in rows] == [1.0, None, None, None, None]


def test_edges_passed_matches_counting(spark):
    edges = [0.0, 1.0, 1.5, 4.0]
    df = spark.createDataFrame([(float(v) / 4,) for v in range(-4, 24)], "v double")
    out = df.select("v", edges_passed(F.col("v"), edges).alias("i"), edges_passed(F.col("v"), edges, False).alias("s"))
    for r in out.collect():
        assert r.i == sum(e <= r.v for e in edges)
        assert r.s == sum(e < r.v for e in edges)


def test_header_aliases():
    assert normalise_header(" Max Packet Length ") == "Packet Length Max"
    assert normalise_header(" Protocol") == "Protocol"


def test_subset_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(2, "a", None), (1, "a", None), (3, "b", 1.0)], "id int, k string, v double")
    kept = clean.remove_duplicates(df, ["k", "v"], ["id"]).collect()
    assert sorted(r.id for r in kept) == [1, 3]
    with pytest.raises(ValueError):
        clean.remove_duplicates(df, ["k"])


def test_conflicting_labels_both_stay(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, label int")
    assert clean.remove_duplicates(df).count() == 2


@pytest.mark.parametrize("strategy", ["wrong", ""])
def test_unknown_strategy(spark, strategy):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError, match="handled by one of"):
        clean.handle_missing(df, ["x"], strategy)


def test_forward_fill_crosses_chunks(spark):
    from flowspark.functions.sequence import fill_gaps

    values = [None, None, 1.0, None, None, None, None, None, 2.0, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    ordered = with_sequence(df, ["id"])
    got = {r.id: r.v for r in fill_gaps(ordered, ["v"], chunk_rows=2).collect()}
    assert [got[i] for i in range(11)] == [1.0] * 8 + [2.0] * 3


def test_rolling_in_chunks_equals_one_window(spark):
    data = [(i, float((i * 7) % 11)) for i in range(53)]
    df = spark.createDataFrame(data, "id int, v double")
    made = features.rolling_statistics(df, ["v"], ["id"], size=10, chunk_rows=10)
    values = [v for _, v in data]
    for r in made.collect():
        window = values[max(0, r.id - 9) : r.id + 1]
        mean = sum(window) / len(window)
        assert r.v_mean == pytest.approx(mean)
        assert (r.v_min, r.v_max) == (min(window), max(window))
        spread = math.sqrt(sum((x - mean) ** 2 for x in window) / (len(window) - 1)) if len(window) > 1 else 0.0
        assert r.v_std == pytest.approx(spread)


def test_sequence_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = with_sequence(df, ["k"]).collect()
    assert all(r.k == r.seq for r in rows)


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 40, 5000):
        values = np.round(rng.normal(size=n), 2)
        df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, g int")
        wanted = [0, 0.1, 0.25, 0.5, 0.9, 0.99, 1]
        found = column_quantiles(df, ["v"], wanted)["v"]
        assert [found[float(q)] for q in wanted] == pytest.approx([np.quantile(values, q) for q in wanted])
        for g, by in group_quantiles(df, "g", "v", [0.5]).items():
            assert by[0.5] == pytest.approx(np.quantile(values[g::3], 0.5))


def test_quantiles_of_any_number_of_groups(spark):
    """A hot group, many groups of one row, values that repeat, missing keys and values; chunks smaller than a group."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [("hot", "x", float(v)) for v in np.round(rng.normal(size=900), 1)] + [(f"g{i % 300}", "y", float(i)) for i in range(450)]
    odd = [(None, "x", 1.0), ("hot", None, 2.0), ("hot", "x", None)]
    df = spark.createDataFrame(rows + odd, "a string, b string, v double")
    wanted = [0.95, 0.0, 0.5, 1.0]
    for chunk in (200_000, 37):
        found = {(r.a, r.b): [r.q0, r.q1, r.q2, r.q3] for r in group_quantile_table(df, ["a", "b"], "v", wanted, chunk).collect()}
        own = {}
        for a, b, v in rows:
            own.setdefault((a, b), []).append(v)
        assert found.keys() == own.keys()
        assert all(found[k] == pytest.approx([np.quantile(v, q) for q in wanted]) for k, v in own.items())


def test_quantiles_survive_bad_brackets(spark, monkeypatch):
    import numpy as np

    from flowspark.functions import quantiles

    values = np.random.default_rng(1).random(4000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    monkeypatch.setattr(quantiles, "_first_ranks", lambda listed: [min(1.0, q + 0.2) for q in listed for _ in (0, 1)])
    assert quantiles.column_quantiles(df, ["v"], [0.5])["v"][0.5] == pytest.approx(np.quantile(values, 0.5))
    monkeypatch.undo()
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 3)
    assert quantiles.column_quantiles(df, ["v"], [0.3])["v"][0.3] == pytest.approx(np.quantile(values, 0.3))


def test_outlier_defaults(spark):
    assert clean.OUTLIER_DEFAULTS == {"iqr": 1.5, "zscore": 3.0}
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 100]], "x double, c double")
    assert clean.remove_outliers(df, ["x", "c"]).count() == 4
    assert clean.remove_outliers(df, ["x", "c"], "zscore").count() == 5
    with pytest.raises(ValueError, match="found by one of"):
        clean.fit_outliers(df, ["x"], "other")


def test_constant_and_quasi_constant(spark):
    rows = [(1.0, None, 0.0 if i else 1.0, float(i), None if i < 4 else 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "c double, empty double, rare double, free double, gap double")
    assert clean.constant_columns(df, df.columns) == ["c", "gap"]
    assert set(clean.quasi_constant_columns(df, df.columns)) == {"c", "rare"}
    assert set(clean.quasi_constant_columns(df, df.columns, 0.5)) == {"c", "rare", "gap"}


def test_holdout_learns_nothing(spark):
    train = spark.createDataFrame([(1.0, 0), (math.inf, 0), (3.0, 1), (3.0, 1)], "x double, label int")
    cleaned, plan = clean.clean_training(train, ["x"], "label", strategy="mean", outliers=None, drop_constant=False)
    # Training rows are filled without their duplicates, holdouts with the mean of all training rows.
    assert plan.fill == {"x": 2.0} and plan.holdout_fill == {"x": pytest.approx(7 / 3)}
    held = spark.createDataFrame([(None, 1), (9.0, 0), (9.0, 0)], "x double, label int")
    assert sorted(r.x for r in clean.clean_holdout(held, plan, ["x"], ["label"]).collect()) == [pytest.approx(7 / 3), 9.0, 9.0]
    with pytest.raises(ValueError, match="known from training"):
        clean.clean_holdout(held.drop("x"), plan, ["x"])


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, c double")
    minmax = scale.fit_scaler(df, ["x", "c"])
    got = scale.apply_scaler(df, minmax).collect()
    assert [r.x for r in got] == [0.0, 0.125, 0.375, 1.0]
    assert {r.c for r in got} == {0.0}
    robust = scale.fit_scaler(df, ["x"], "robust")
    assert robust.shift == (3.0,) and robust.scale == (5.25 - 1.75,)
    wider = spark.createDataFrame([(17.0, 5.0)], "x double, c double")
    assert scale.apply_scaler(wider, minmax).first().x == 2.0
    assert scale.Scaler.from_table(minmax.table(spark), "minmax") == minmax
    with pytest.raises(ValueError, match="no scaling by"):
        scale.fit_scaler(df, ["x"], "other")


@pytest.mark.parametrize("bad", [None, math.inf, math.nan])
def test_scaler_rejects_unusable_values(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "x double")
    with pytest.raises(ValueError, match="missing or infinite"):
        scale.fit_scaler(df, ["x"])


def test_scaler_rejects_text_and_empty(spark):
    with pytest.raises(ValueError, match="Columns of text"):
        scale.fit_scaler(spark.createDataFrame([("a",)], "x string"), ["x"])
    with pytest.raises(ValueError, match="no row"):
        scale.fit_scaler(spark.createDataFrame([], "x double"), ["x"])
    with pytest.raises(ValueError, match="fitted on"):
        scale.require_schema(spark.createDataFrame([(1, 2)], "b int, a int"), ["a", "b"])


def test_labels(spark):
    df = spark.createDataFrame([(1, "Benign"), (2, "DDoS"), (3, None)], "Feature int, Label string")
    out = labels.standardize_labels(df)
    assert out.columns == ["Feature", "label"]
    assert [r.label for r in out.orderBy("Feature").collect()] == [0, 1, 1]
    same = spark.createDataFrame([(1,)], "Feature int")
    assert labels.standardize_labels(same).columns == ["Feature"]
    with pytest.raises(ValueError, match="One label column"):
        labels.external_label_column(["Label", "label"])


def test_label_contract(spark):
    good = spark.createDataFrame([(0,), (1,)], "label int")
    labels.check_labels(good)
    assert labels.single_source(good) is good
    for bad in ([(1,), (2,)], [(1,), (1,)], [(0,), (1,), (None,)]):
        with pytest.raises(ValueError):
            labels.check_labels(spark.createDataFrame(bad, "label int"))
    labels.check_labels(spark.createDataFrame([(0,), (1,), (None,)], "label int"), allow_missing=True)
    with pytest.raises(ValueError, match="both classes"):
        labels.check_trainable(spark.createDataFrame([(1,), (1,)], "label int"))


def test_scores_one_per_feature(spark):
    rows = [(0.0, 1.0, 0), (0.1, 0.9, 0), (0.8, 0.2, 1), (0.9, 0.1, 1)]
    df = spark.createDataFrame(rows, "first double, second double, y int")
    for method in selection.SCORE_METHODS:
        assert {r.feature for r in selection.feature_scores(df, ["first", "second"], "y", method).collect()} == {"first", "second"}
    with pytest.raises(ValueError, match="must be one of"):
        selection.feature_scores(df, ["first"], "y", "other")
    with pytest.raises(ValueError, match="whole number"):
        selection.top_features(df, ["first"], "y", 0)


def test_correlated_removal_is_not_greedy(spark):
    rows = [(float(i), 2.0 * i, float(i) + (i % 2) * 0.01, float((i * 37) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert selection.correlated_features(df, ["a", "b", "c", "d"]) == ["b", "c"]


def test_correlations_with_gaps_in_one_scan(spark):
    """80 columns, each with its own gaps, a constant one and one that is empty, against the built-in aggregate."""
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(80)] for _ in range(300)]
    rows = [[None if rng.random() < 0.2 else 1e6 + v + 0.7 * r[0] for v in r] for r in base]
    for r in rows:
        r[78], r[79] = 0.1, None
    names = [f"c{i}" for i in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    found = selection.correlations(df, names)
    assert len(found) == 78 * 77 // 2
    some = [(names[i], names[j]) for i, j in [(0, 1), (0, 77), (3, 4), (40, 60)]]
    expected = df.agg(*[F.corr(a, b) for a, b in some]).first()
    assert [found[p] for p in some] == pytest.approx(list(expected), rel=1e-9)


def slow_information(values, k):
    """The nearest-neighbour estimate by comparing all pairs; ``values``: (x, class)."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    sizes = {y: sum(c == y for _, c in values) for _, y in values}
    values = [(x, y) for x, y in values if sizes[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(values):
        gaps = sorted(abs(x - v) for j, (v, c) in enumerate(values) if c == y and j != i)
        own = min(k, sizes[y] - 1)
        r = gaps[own - 1]
        if r == 0:
            own, m = gaps.count(0.0), sum(v == x for v, _ in values)
        else:
            m = sum(x - r < v < x + r for v, _ in values)
        total += psi(own) - psi(sizes[y]) - psi(m)
    return max(0.0, psi(len(values)) + total / len(values))


def test_neighbour_information_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(220):
        y = rng.choice([0, 0, 1])
        rows.append((i, rng.gauss(2 * y, 1), float(rng.choice([0, 0, 1, 2]) + y), rng.random(), None if i % 9 == 0 else rng.choice([0.5, rng.random()]), y))
    rows += [(900, 1.0, 1.0, 0.3, 0.2, 7), (901, float("nan"), None, None, None, 0), (902, 3.0, 1.0, 0.1, 0.1, 8), (903, 4.0, 1.0, 0.2, 0.1, 8)]
    df = spark.createDataFrame(rows, "id int, normal double, lattice double, noise double, mixed double, y int")
    for chunk in (200_000, 23):
        got = {r.feature: r.score for r in neighbours.neighbour_mutual_information(df, ["normal", "lattice", "noise", "mixed"], "y", chunk_rows=chunk).collect()}
        for at, name in enumerate(["normal", "lattice", "noise", "mixed"], start=1):
            own = [(r[at], r[5]) for r in rows if r[at] is not None and r[at] == r[at]]
            assert got[name] == pytest.approx(slow_information(own, 3), abs=1e-9), (chunk, name)
    assert got["normal"] > got["noise"] + 0.1


def test_network_features_only_when_present(spark):
    df = spark.createDataFrame([(1, 80, 2000)], "id int, src_port int, dst_port int")
    row = features.network_features(df, ["id"]).first().asDict()
    assert row == {"id": 1, "port_range": 1920, "src_port_high": 0, "dst_port_high": 1}


def test_interactions_use_all_columns(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(25))], [f"c{i}" for i in range(25)])
    assert len(features.interactions(df).columns) == 25 + 300


def test_fixed_schema_reports_missing(spark):
    df = spark.createDataFrame([(1.0, 0)], "a double, label int")
    with pytest.raises(ValueError, match=r"\['b'\]"):
        selection.fit_features(df, ["a"], "label", fixed=["a", "b"])


def test_nan_and_infinity_are_gaps(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, float(k % 5), 1.0) for k in range(30)] + [(30, nan, nan), (31, inf, 1.0), (32, None, None), (33, 900.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, v double, w double")
    kept = {r.k for r in clean.remove_outliers(df, ["v"], "zscore").collect()}
    assert kept == set(range(33))
    assert {r.k for r in clean.remove_outliers(df, ["v"], "iqr").collect()} == set(range(33))
    assert clean.constant_columns(df, ["v", "w"]) == ["w"]
    filled = {r.k: r.v for r in clean.handle_missing(df, ["v"], "median").collect()}
    assert filled[30] == filled[31] == filled[32] == 2.0
    carried = {r.k: r.v for r in clean.handle_missing(df, ["v"], "forward_fill", order_by=["k"]).collect()}
    assert carried[30] == carried[31] == carried[32] == 4.0


def test_rows_are_not_dealt_by_their_category(spark):
    from flowspark.operators.features import network_features

    rows = spark.createDataFrame([(i, "b" if i % 10 else "a" if i % 20 else None) for i in range(100)], "id int, protocol string")
    # What a cluster sees whose tables have no known size: only a local list may be sent to the rows.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = network_features(rows, ["id"])
        assert "Exchange hashpartitioning" not in coded._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.protocol for r in coded.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: 1 if i % 10 else 0 if i % 20 else -1 for i in range(100)}
