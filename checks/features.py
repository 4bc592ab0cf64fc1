"""Derived features, scores, selection."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.base import FEATURES, FLOW_SQL, NET_SQL, NUMERIC_SQL, flow, net, numeric, query, rounded, table
from flowspark.operators import features, selection
from flowspark.operators.neighbours import digamma, neighbour_mutual_information
from flowspark.session import local_table

WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("rolling10", f"""SELECT user_id, event_id, round(avg(value) OVER w, 6) AS value_mean,
    round(coalesce(stddev_samp(value) OVER w, 0), 6) AS value_std, min(value) OVER w AS value_min, max(value) OVER w AS value_max
    FROM events WINDOW w AS {WINDOW}""")
def rolling10(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    made = features.rolling_statistics(rows, ["value"], ["ts", "event_id"], ["user_id"])
    return rounded(made.select("user_id", "event_id", "value_mean", "value_std", "value_min", "value_max"))


@query("port_features", f"""WITH {NET_SQL} SELECT row_id, dst_port - src_port AS port_range,
    CAST(src_port > 1024 AS INT) AS src_port_high, CAST(dst_port > 1024 AS INT) AS dst_port_high FROM net""")
def port_features(spark, folder):
    return features.network_features(net(spark, folder).select("row_id", "src_port", "dst_port"), ["row_id"])


@query("category_codes", f"""WITH {NET_SQL}, k AS (SELECT protocol AS pr, row_number() OVER (ORDER BY protocol) - 1 AS code
    FROM (SELECT DISTINCT protocol FROM net WHERE protocol <> 'N'))
    SELECT row_id, CAST(coalesce(code, -1) AS INT) AS protocol FROM net LEFT JOIN k ON pr = protocol""")
def category_codes(spark, folder):
    rows = net(spark, folder).select("row_id", F.expr("nullif(protocol, 'N')").alias("protocol"))
    return features.network_features(rows, ["row_id"])


@query("byte_features", f"""WITH {NET_SQL} SELECT row_id, bytes_sent + bytes_received AS total_bytes,
    (bytes_sent + 1) / (bytes_received + 1) AS byte_ratio FROM net""")
def byte_features(spark, folder):
    rows = net(spark, folder).select("row_id", "bytes_sent", "bytes_received")
    return features.network_features(rows, ["row_id"])


PRODUCTS = [(a, b) for a, b in combinations(FEATURES, 2)]
PRODUCT_SQL = ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in PRODUCTS)


@query("interactions", f"""WITH {FLOW_SQL} SELECT row_id, {', '.join(FEATURES)},
    {PRODUCT_SQL} FROM flow""")
def interactions(spark, folder):
    return features.interactions(flow(spark, folder).select("row_id", *FEATURES), FEATURES)


def anova_sql(source: str, columns: list[str]) -> str:
    """F = between-class over within-class mean square, for every column of ``source``."""
    return f"""long AS (UNPIVOT (SELECT label, {', '.join(columns)} FROM {source}) ON {', '.join(columns)} INTO NAME feature VALUE x),
    g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY feature, label),
    o AS (SELECT feature, count(*) AS n, avg(x) AS m FROM long GROUP BY feature),
    fs AS (SELECT g.feature, (sum(g.n * (g.m - o.m) * (g.m - o.m)) / (count(*) - 1)) / (sum(g.n * g.v) / (max(o.n) - count(*))) AS score
      FROM g JOIN o ON g.feature = o.feature GROUP BY g.feature),
    places AS (SELECT unnest({columns!r}) AS feature, unnest(range({len(columns)})) AS position)"""


@query("anova_f", f"""WITH {FLOW_SQL}, {anova_sql('flow', FEATURES)} SELECT fs.feature, CAST(position AS INT) AS position,
    round(score, 6) AS score FROM fs JOIN places ON fs.feature = places.feature""")
def anova_f(spark, folder):
    return rounded(selection.anova_f(flow(spark, folder), FEATURES, "label"))


@query("top_k_features", f"""WITH {FLOW_SQL}, {anova_sql('flow', FEATURES)}, b AS (SELECT fs.feature, position FROM fs
    JOIN places ON fs.feature = places.feature ORDER BY score DESC, position LIMIT 3)
    SELECT feature, CAST(row_number() OVER (ORDER BY position) - 1 AS INT) AS place FROM b""")
def top_k_features(spark, folder):
    names = selection.top_features(flow(spark, folder), FEATURES, "label", 3)
    return local_table(spark, [(n, i) for i, n in enumerate(names)], "feature string, place int")


@query("feature_pipeline", f"""WITH {FLOW_SQL}, wide AS (SELECT label, {', '.join(FEATURES)}, {PRODUCT_SQL} FROM flow),
    {anova_sql('wide', FEATURES + [f'{a}_x_{b}' for a, b in PRODUCTS])},
    b AS (SELECT fs.feature, position FROM fs JOIN places ON fs.feature = places.feature ORDER BY score DESC, position LIMIT 6)
    SELECT feature, CAST(row_number() OVER (ORDER BY position) - 1 AS INT) AS place FROM b""")
def feature_pipeline(spark, folder):
    plan = selection.fit_features(
        flow(spark, folder), FEATURES, "label", create_interactions=True, n_features=6, correlation_threshold=0.95
    )
    return local_table(spark, [(n, i) for i, n in enumerate(plan.selected)], "feature string, place int")


@query("fixed_schema", f"WITH {FLOW_SQL} SELECT row_id, l_tax, l_quantity FROM flow")
def fixed_schema(spark, folder):
    rows = flow(spark, folder)
    plan = selection.fit_features(rows, FEATURES, "label", fixed=["l_tax", "l_quantity"])
    return selection.apply_features(rows, plan, ["row_id"])


@query("low_variance", f"""WITH {FLOW_SQL}, v AS (SELECT {', '.join(f'var_pop({c}) AS {c}' for c in FEATURES)} FROM flow)
    SELECT feature, round(x, 8) AS variance FROM (UNPIVOT v ON {', '.join(FEATURES)} INTO NAME feature VALUE x) WHERE x <= 1e-2""")
def low_variance(spark, folder):
    return rounded(selection.low_variance(flow(spark, folder), FEATURES), 8)


CORR = [(a, b) for a, b in combinations([*FEATURES, "p"], 2)]
CORR_SQL = "cr AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS later, '{a}' AS earlier, abs(corr({a}, {b})) AS correlation FROM flow" for a, b in CORR
) + "))"


@query("corr_pairs", f"WITH {FLOW_SQL}, {CORR_SQL} SELECT later, earlier, round(correlation, 6) AS correlation FROM cr WHERE correlation > 5e-1")
def corr_pairs(spark, folder):
    return rounded(selection.correlated_pairs(flow(spark, folder), [*FEATURES, "p"], 0.5))


@query("corr_drop", f"WITH {FLOW_SQL}, {CORR_SQL} SELECT DISTINCT later AS feature FROM cr WHERE correlation > 5e-1")
def corr_drop(spark, folder):
    names = selection.correlated_features(flow(spark, folder), [*FEATURES, "p"], 0.5)
    return local_table(spark, [(n,) for n in names], "feature string")


def edges_sql(column: str, source: str = "flow", points: int = 10) -> str:
    inner = ", ".join(f"{i}e-1" for i in range(1, points))
    return f"(SELECT list_distinct(quantile_cont({column}, [{inner}])) FROM {source})"


@query("binned_mi", f"""WITH {FLOW_SQL}, b AS (SELECT label, {', '.join(
    f"len(list_filter({edges_sql(c)}, lambda e: e <= {c})) AS {c}" for c in FEATURES)} FROM flow),
    v AS (UNPIVOT b ON {', '.join(FEATURES)} INTO NAME feature VALUE bin),
    j AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY feature, bin, label),
    k AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS ny,
      sum(n) OVER (PARTITION BY feature) AS nt FROM j),
    places AS (SELECT unnest({FEATURES!r}) AS f, unnest(range({len(FEATURES)})) AS position)
    SELECT feature, CAST(max(position) AS INT) AS position, round(sum(n / nt * ln(n * nt / (nb * ny))), 9) AS score
    FROM k JOIN places ON f = feature GROUP BY feature""")
def binned_mi(spark, folder):
    return rounded(selection.binned_mutual_information(flow(spark, folder), FEATURES, "label"), 9)


MI_CELLS = f"""v AS (UNPIVOT (SELECT label, {', '.join(FEATURES)} FROM flow) ON {', '.join(FEATURES)} INTO NAME feature VALUE x),
    ce AS (SELECT feature, label AS y, x, count(*) AS c FROM v GROUP BY ALL),
    ny AS (SELECT *, sum(c) OVER (PARTITION BY feature, y) AS ny,
      list({{'x': x, 'c': c}}) OVER (PARTITION BY feature, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM ce),
    re AS (SELECT *, CASE WHEN c - 1 >= 3 THEN 0 ELSE list_sort(flatten(list_transform(list_filter(near, lambda s: s.x <> x),
      lambda s: list_transform(range(least(s.c, 3)), lambda i: abs(s.x - x)))))[3 - (c - 1)] END AS r FROM ny),
    pt AS (SELECT feature, x, sum(c) AS n FROM ce GROUP BY feature, x),
    cu AS (SELECT feature, x, n, sum(n) OVER (PARTITION BY feature ORDER BY x) AS upto FROM pt),
    hi AS (SELECT re.*, re.x - r AS low, h.upto AS high FROM re ASOF LEFT JOIN cu AS h ON re.feature = h.feature AND re.x + r > h.x),
    bo AS (SELECT hi.feature, hi.x, hi.y, hi.c, hi.ny, hi.r, coalesce(hi.high, 0) - coalesce(l.upto, 0) AS between
      FROM hi ASOF LEFT JOIN cu AS l ON hi.feature = l.feature AND hi.low >= l.x),
    mm AS (SELECT bo.*, CASE WHEN r = 0 THEN pt.n ELSE between END AS m, CASE WHEN r = 0 THEN c - 1 ELSE 3 END AS k
      FROM bo JOIN pt ON bo.feature = pt.feature AND bo.x = pt.x)"""


@query("neighbour_mi", f"""WITH {FLOW_SQL}, {MI_CELLS},
    places AS (SELECT unnest({FEATURES!r}) AS f, unnest(range({len(FEATURES)})) AS position),
    sc AS (SELECT feature, sum(c) AS n, sum(c * ({digamma('k')} - {digamma('ny')} - {digamma('m')})) AS s FROM mm GROUP BY feature)
    SELECT feature, CAST(position AS INT) AS position, round(greatest(0, {digamma('n')} + s / n), 9) AS score FROM sc JOIN places ON f = feature""")
def neighbour_mi(spark, folder):
    return rounded(neighbour_mutual_information(flow(spark, folder), FEATURES, "label"), 9)


GAPPED = ["price", "discount", "quantity", "label"]


@query("corr_gaps", f"WITH {NUMERIC_SQL} " + " UNION ALL ".join(
    f"SELECT '{b}' AS later, '{a}' AS earlier, round(corr({a}, {b}), 9) AS correlation FROM num" for a, b in combinations(GAPPED, 2)))
def corr_gaps(spark, folder):
    """Every pair over the rows that hold both of its values."""
    found = selection.correlations(numeric(spark, folder), GAPPED)
    return local_table(spark, [(b, a, round(r, 9)) for (a, b), r in found.items()], "later string, earlier string, correlation double")


@query("importance_stability", f"""WITH {FLOW_SQL}, w AS (SELECT l_linenumber AS fold, avg(l_quantity) AS l_quantity,
    avg(l_tax) AS l_tax, avg(l_discount) AS l_discount FROM flow GROUP BY l_linenumber),
    i AS (UNPIVOT w ON l_quantity, l_tax, l_discount INTO NAME feature VALUE importance)
    SELECT feature, round(avg(importance), 6) AS mean_importance, round(stddev_samp(importance), 6) AS std_importance,
    count(DISTINCT fold) AS folds_selected, round(CAST(count(DISTINCT fold) AS DOUBLE) / 7, 6) AS selection_frequency
    FROM i GROUP BY feature""")
def importance_stability(spark, folder):
    names = ["l_quantity", "l_tax", "l_discount"]
    wide = flow(spark, folder).groupBy(F.col("l_linenumber").alias("fold")).agg(*[F.avg(n).alias(n) for n in names])
    return rounded(selection.importance_stability(wide.unpivot(["fold"], names, "feature", "importance"), 7))
