"""Table profiles."""


from checks.base import DIRTY_SQL, FEATURES, FLOW_SQL, dirty, flow, query, rounded, table
from flowspark.operators import explore

DIRTY_COLUMNS = ["row_id", "quantity_text", "price_text", "discount", "label_text"]


@query("profile", f"""WITH {DIRTY_SQL} SELECT count(*) AS rows, CAST(5 AS INT) AS columns,
    CAST(sum(CAST(discount IS NULL AS INT) + CAST(label_text IS NULL AS INT)) AS BIGINT) AS missing_cells,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DIRTY_COLUMNS)} FROM dirty)) AS duplicates FROM dirty""")
def profile(spark, folder):
    return explore.profile(dirty(spark, folder).select(*DIRTY_COLUMNS))


@query("column_info", f"""WITH {DIRTY_SQL} SELECT 'price_text' AS "column", 'string' AS type, count(price_text) AS non_null, count(DISTINCT price_text) AS "unique" FROM dirty
    UNION ALL SELECT 'discount', 'double', count(discount), count(DISTINCT discount) FROM dirty
    UNION ALL SELECT 'label_text', 'string', count(label_text), count(DISTINCT label_text) FROM dirty""")
def column_info(spark, folder):
    return explore.column_info(dirty(spark, folder).select("price_text", "discount", "label_text"))


@query("describe_num", f"""WITH {FLOW_SQL}, l AS (UNPIVOT flow ON {', '.join(FEATURES)} INTO NAME feature VALUE x)
    SELECT feature, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min,
    round(quantile_cont(x, 25e-2), 4) AS q1, round(quantile_cont(x, 5e-1), 4) AS median, round(quantile_cont(x, 75e-2), 4) AS q3,
    max(x) AS max FROM l GROUP BY feature""")
def describe_num(spark, folder):
    return rounded(explore.describe(flow(spark, folder), FEATURES), 4)


@query("feature_summary", f"""WITH {DIRTY_SQL} SELECT CAST(5 AS INT) AS features, count(*) AS samples,
    CAST(sum(CAST(discount IS NULL AS INT) + CAST(label_text IS NULL AS INT)) AS BIGINT) AS missing_cells,
    CAST(1 AS INT) AS numeric_columns, CAST(4 AS INT) AS other_columns FROM dirty""")
def feature_summary(spark, folder):
    return explore.feature_summary(dirty(spark, folder).select(*DIRTY_COLUMNS))


@query("label_dist", f"""WITH {DIRTY_SQL} SELECT label_text AS label, count(*) AS rows,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dirty) * 100, 6) AS percent FROM dirty
    WHERE label_text IS NOT NULL GROUP BY label_text""")
def label_dist(spark, folder):
    return rounded(explore.label_distribution(dirty(spark, folder).select("row_id", "label_text")))


@query("file_summary", """WITH k AS (SELECT l_linestatus AS source, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label DESC) AS i FROM k)
    SELECT source, CAST(sum(n) AS BIGINT) AS rows, max(label) FILTER (i = 1) AS primary_label FROM t GROUP BY source
    UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), NULL FROM k""")
def file_summary(spark, folder):
    return explore.source_summary(table(spark, folder, "lineitem"), "l_linestatus", "l_returnflag")


@query("sample_rows", f"WITH {FLOW_SQL} SELECT row_id, l_quantity, label FROM flow ORDER BY row_id LIMIT 5")
def sample_rows(spark, folder):
    return explore.sample_rows(flow(spark, folder).select("row_id", "l_quantity", "label"), ["row_id"])


@query("missing_top10", f"""WITH {DIRTY_SQL} SELECT 'discount' AS "column", count(*) FILTER (discount IS NULL) AS missing FROM dirty
    UNION ALL SELECT 'label_text', count(*) FILTER (label_text IS NULL) FROM dirty""")
def missing_top10(spark, folder):
    return explore.missing_top(dirty(spark, folder).select(*DIRTY_COLUMNS))


@query("hist30", f"""WITH {FLOW_SQL}, l AS (UNPIVOT flow ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x),
    m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
    g AS (SELECT feature, lo, (hi - lo) / 30 AS step, hi, unnest(range(30)) AS bin FROM m),
    ed AS (SELECT feature, bin, lo + bin * step AS lower, CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * step END AS upper FROM g)
    SELECT ed.feature, CAST(bin AS INT) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
    (SELECT count(*) FROM l WHERE l.feature = ed.feature AND x >= lower AND (x < upper OR (bin = 29 AND x <= upper))) AS n FROM ed""")
def hist30(spark, folder):
    return rounded(explore.histograms(flow(spark, folder), ["l_quantity", "l_discount", "l_tax"]))
