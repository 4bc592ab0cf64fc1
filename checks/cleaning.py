"""Coercion, labels, deduplication, imputation, outliers, uninformative columns."""

from pyspark.sql import functions as F

from checks.base import DIRTY_SQL, FEATURES, FLOW_SQL, NUMERIC_SQL, dirty, flow, numeric, query, rounded, table
from flowspark.functions.expr import all_present, finite, to_number
from flowspark.operators import clean, labels
from flowspark.session import local_table

NUMS = ["quantity", "price", "discount"]


@query("finite_guard", f"""WITH {DIRTY_SQL} SELECT row_id, copy,
    CASE WHEN isfinite(TRY_CAST(price_text AS DOUBLE)) THEN TRY_CAST(price_text AS DOUBLE) END AS price FROM dirty""")
def finite_guard(spark, folder):
    value = F.when(F.col("price_text") != "", F.col("price_text")).try_cast("double")
    return dirty(spark, folder).select("row_id", "copy", finite(value).alias("price"))


@query("lenient_cast", f"WITH {NUMERIC_SQL} SELECT row_id, copy, quantity, price FROM num")
def lenient_cast(spark, folder):
    return dirty(spark, folder).select(
        "row_id",
        "copy",
        to_number(F.col("quantity_text")).alias("quantity"),
        to_number(F.col("price_text")).alias("price"),
    )


@query("valid_rows", f"""WITH {NUMERIC_SQL} SELECT row_id, copy, quantity, price, discount FROM num
    WHERE quantity IS NOT NULL AND price IS NOT NULL AND discount IS NOT NULL""")
def valid_rows(spark, folder):
    rows = numeric(spark, folder).drop("label")
    return rows.where(all_present([F.col(c) for c in NUMS]))


@query("label_substring", f"""WITH {DIRTY_SQL} SELECT row_id, copy,
    CAST(CASE WHEN lower(label_text) LIKE '%benign%' THEN 0 ELSE 1 END AS INT) AS label FROM dirty""")
def label_substring(spark, folder):
    named = dirty(spark, folder).select("row_id", "copy", F.col("label_text").alias("Label"))
    return labels.standardize_labels(named)


@query("label_exact", f"""WITH {DIRTY_SQL} SELECT row_id, copy,
    CAST(CASE WHEN trim(label_text) = 'BENIGN' THEN 0 ELSE 1 END AS INT) AS label
    FROM dirty WHERE trim(label_text) <> ''""")
def label_exact(spark, folder):
    coded = dirty(spark, folder).select("row_id", "copy", labels.exact_label(F.col("label_text")).alias("label"))
    return coded.where("label IS NOT NULL")


@query("label_contract", f"""WITH {DIRTY_SQL} SELECT bool_or(label = 0) AS has_benign, bool_or(label = 1) AS has_attack,
    count(*) FILTER (label NOT IN (0, 1)) AS other_rows, count(*) FILTER (label IS NULL) AS missing_rows,
    bool_or(label = 0) AND bool_or(label = 1) AND count(*) FILTER (label NOT IN (0, 1)) = 0 AS contract_holds
    FROM dirty""")
def label_contract(spark, folder):
    return labels.label_summary(dirty(spark, folder))


@query("dedup_first", f"""WITH {DIRTY_SQL}, r AS (SELECT *, row_number() OVER
    (PARTITION BY label_text, quantity_text, discount ORDER BY row_id, copy) AS n FROM dirty)
    SELECT row_id, copy, label_text, quantity_text, discount, price_text FROM r WHERE n = 1""")
def dedup_first(spark, folder):
    rows = dirty(spark, folder).select("row_id", "copy", "label_text", "quantity_text", "discount", "price_text")
    return clean.remove_duplicates(rows, ["label_text", "quantity_text", "discount"], ["row_id", "copy"])


@query("dedup_with_label", f"WITH {NUMERIC_SQL} SELECT DISTINCT quantity, price, discount, label FROM num")
def dedup_with_label(spark, folder):
    return clean.remove_duplicates(numeric(spark, folder).select(*NUMS, "label"))


@query("drop_missing", f"""WITH {NUMERIC_SQL} SELECT row_id, copy, quantity, price, discount, label FROM num
    WHERE price IS NOT NULL AND discount IS NOT NULL""")
def drop_missing(spark, folder):
    return clean.handle_missing(numeric(spark, folder), NUMS, "drop")


@query("impute_mean", f"""WITH {NUMERIC_SQL}, m AS (SELECT avg(price) AS mp, avg(discount) AS md FROM num)
    SELECT row_id, copy, quantity, label, round(coalesce(price, mp), 6) AS price, round(coalesce(discount, md), 6) AS discount FROM num, m""")
def impute_mean(spark, folder):
    return rounded(clean.handle_missing(numeric(spark, folder), NUMS, "mean"))


@query("impute_median", f"""WITH {NUMERIC_SQL} SELECT row_id, copy, quantity, label,
    round(coalesce(price, (SELECT quantile_cont(price, 5e-1) FROM num)), 6) AS price,
    round(coalesce(discount, (SELECT quantile_cont(discount, 5e-1) FROM num)), 6) AS discount FROM num""")
def impute_median(spark, folder):
    return rounded(clean.handle_missing(numeric(spark, folder), NUMS, "median"))


@query("impute_holdout", f"""WITH {NUMERIC_SQL}, m AS (SELECT avg(price) AS mp, avg(discount) AS md FROM (SELECT * FROM num WHERE copy = 0 UNION ALL
      SELECT * FROM num WHERE copy = 0 AND quantity < 20))
    SELECT row_id, quantity, label, round(coalesce(price, mp), 6) AS price, round(coalesce(discount, md), 6) AS discount
    FROM num, m WHERE copy = 1""")
def impute_holdout(spark, folder):
    """Small flows occur twice in the training rows: their copies go, but count in what holdouts are filled with."""
    rows = numeric(spark, folder)
    training = rows.where("copy = 0").unionByName(rows.where("copy = 0 AND quantity < 20"))
    _, plan = clean.clean_training(training, NUMS, "label", strategy="mean", outliers=None, drop_constant=False)
    return rounded(clean.clean_holdout(rows.where("copy = 1"), plan, NUMS, ["row_id", "label"]))


GAPS = "g AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)"


@query("ffill_bfill", f"""WITH {GAPS} SELECT user_id, event_id, coalesce(
    last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""")
def ffill_bfill(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "user_id", "event_id", "ts", "CASE WHEN event_id % 3 <> 0 THEN value END AS v"
    )
    return clean.forward_fill(rows, ["v"], ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "v")


@query("outlier_iqr", f"""WITH {FLOW_SQL}, b AS (SELECT quantile_cont(l_quantity, 25e-2) AS a1, quantile_cont(l_quantity, 75e-2) AS a3,
    quantile_cont(l_extendedprice, 25e-2) AS b1, quantile_cont(l_extendedprice, 75e-2) AS b3 FROM flow)
    SELECT row_id, l_quantity < a1 - 3e-1 * (a3 - a1) OR l_quantity > a3 + 3e-1 * (a3 - a1)
      OR l_extendedprice < b1 - 3e-1 * (b3 - b1) OR l_extendedprice > b3 + 3e-1 * (b3 - b1) AS outlier FROM flow, b""")
def outlier_iqr(spark, folder):
    rows = flow(spark, folder)
    ranges = clean.fit_outliers(rows, ["l_quantity", "l_extendedprice"], "iqr", 0.3)
    return rows.select("row_id", clean.outlier_flag(ranges).alias("outlier"))


@query("outlier_z", f"""WITH {FLOW_SQL}, b AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa,
    avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb FROM flow)
    SELECT row_id, l_quantity, l_extendedprice FROM flow, b
    WHERE NOT (abs(l_quantity - ma) > 15e-1 * sa OR abs(l_extendedprice - mb) > 15e-1 * sb)""")
def outlier_z(spark, folder):
    rows = flow(spark, folder).withColumn("one", F.lit(1.0))
    kept = clean.remove_outliers(rows, ["l_quantity", "l_extendedprice", "one"], "zscore", 1.5)
    return kept.select("row_id", "l_quantity", "l_extendedprice")


def _with_dull_columns(df):
    return df.withColumns(
        {"fixed": F.lit(1.0), "rare": F.when(F.col("l_orderkey") % 40 == 0, 1.0).otherwise(0.0)}
    )


@query("constant_cols", f"""WITH {FLOW_SQL}, c AS (SELECT *, 1e0 AS fixed,
    CASE WHEN l_orderkey % 40 = 0 THEN 1e0 ELSE 0e0 END AS rare FROM flow), n AS (SELECT count(DISTINCT l_quantity) AS l_quantity,
    count(DISTINCT l_tax) AS l_tax, count(DISTINCT fixed) AS fixed, count(DISTINCT rare) AS rare FROM c)
    SELECT feature FROM (UNPIVOT n ON l_quantity, l_tax, fixed, rare INTO NAME feature VALUE d) WHERE d = 1""")
def constant_cols(spark, folder):
    rows = _with_dull_columns(flow(spark, folder))
    names = clean.constant_columns(rows, ["l_quantity", "l_tax", "fixed", "rare"])
    return local_table(spark, [(n,) for n in names], "feature string")


@query("quasi_constant_cols", f"""WITH {FLOW_SQL}, c AS (SELECT CASE WHEN l_orderkey % 40 = 0 THEN 1e0 ELSE 0e0 END AS rare,
    l_tax, l_discount FROM flow), v AS (UNPIVOT c ON rare, l_tax, l_discount INTO NAME feature VALUE x),
    f AS (SELECT feature, x, count(*) AS n FROM v GROUP BY feature, x)
    SELECT feature, round(CAST(max(n) AS DOUBLE) / (SELECT count(*) FROM flow), 6) AS share FROM f
    GROUP BY feature HAVING CAST(max(n) AS DOUBLE) / (SELECT count(*) FROM flow) > 95e-2""")
def quasi_constant_cols(spark, folder):
    rows = _with_dull_columns(flow(spark, folder))
    found = clean.quasi_constant_columns(rows, ["rare", "l_tax", "l_discount"])
    return rounded(local_table(spark, list(found.items()), "feature string, share double"))


@query("clean_pipeline", f"""WITH {NUMERIC_SQL}, u AS (SELECT DISTINCT quantity, price, discount, label FROM num
      WHERE price IS NOT NULL AND discount IS NOT NULL),
    b AS (SELECT quantile_cont(quantity, 25e-2) AS a1, quantile_cont(quantity, 75e-2) AS a3,
      quantile_cont(price, 25e-2) AS b1, quantile_cont(price, 75e-2) AS b3,
      quantile_cont(discount, 25e-2) AS c1, quantile_cont(discount, 75e-2) AS c3 FROM u)
    SELECT quantity, price, discount, label FROM u, b
    WHERE quantity BETWEEN a1 - 15e-1 * (a3 - a1) AND a3 + 15e-1 * (a3 - a1)
      AND price BETWEEN b1 - 15e-1 * (b3 - b1) AND b3 + 15e-1 * (b3 - b1)
      AND discount BETWEEN c1 - 15e-1 * (c3 - c1) AND c3 + 15e-1 * (c3 - c1)""")
def clean_pipeline(spark, folder):
    rows = numeric(spark, folder).select(*NUMS, F.lit(1.0).alias("fixed"), "label")
    cleaned, plan = clean.clean_training(rows, [*NUMS, "fixed"], "label")
    return cleaned


@query("scale_minmax", f"""WITH {FLOW_SQL} SELECT row_id, {', '.join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in FEATURES)} FROM flow""")
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("scale_z", f"""WITH {FLOW_SQL}, m AS (SELECT {', '.join(
    f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)} FROM flow)
    SELECT row_id, {', '.join(f"round(({c} - a_{c}) / s_{c}, 6) AS {c}" for c in FEATURES)} FROM flow, m""")
def scale_z(spark, folder):
    return _scaled(spark, folder, "zscore")


@query("scale_robust", f"""WITH {FLOW_SQL}, m AS (SELECT {', '.join(
    f"quantile_cont({c}, 5e-1) AS a_{c}, quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2) AS s_{c}" for c in FEATURES)}
    FROM flow) SELECT row_id, {', '.join(f"round(({c} - a_{c}) / s_{c}, 6) AS {c}" for c in FEATURES)} FROM flow, m""")
def scale_robust(spark, folder):
    return _scaled(spark, folder, "robust")


def _scaled(spark, folder, method):
    from flowspark.operators.scale import apply_scaler, fit_scaler

    rows = flow(spark, folder)
    return rounded(apply_scaler(rows, fit_scaler(rows, FEATURES, method)).select("row_id", *FEATURES))
