"""Stratified splits, folds and resampling against window-function SQL."""

from pyspark.sql import functions as F

from checks.base import FLOW_SQL, flow, query, rounded
from flowspark.operators import split
from flowspark.session import local_table


def ranked(source: str, seed: int, name: str = "h") -> str:
    return (
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || row_id)) AS r FROM {source})"
    )


def shares(source: str, size: str, prefix: str, count: str = "n") -> str:
    """Largest-remainder shares of ``size`` rows among the classes of ``source``."""
    return f"""{prefix}e AS (SELECT label, {count} AS n, CAST({count} * {size} AS DOUBLE) / sum({count}) OVER () AS x FROM {source}),
    {prefix}f AS (SELECT label, n, CAST(floor(x) AS BIGINT) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS k FROM {prefix}e),
    {prefix} AS (SELECT label, n, f + CASE WHEN k <= {size} - (SELECT sum(f) FROM {prefix}f) THEN 1 ELSE 0 END AS s FROM {prefix}f)"""


COUNTS = "c AS (SELECT label, count(*) AS n FROM flow GROUP BY label)"


@query("split3", f"""WITH {FLOW_SQL}, {ranked('flow', 42)}, {COUNTS},
    t AS (SELECT CAST(sum(n) - ceil(2e-1 * sum(n)) AS BIGINT) AS rest FROM c),
    {shares('c', '(SELECT rest FROM t)', 'a')},
    t2 AS (SELECT CAST(rest - ceil(1e-1 / (7e-1 + 1e-1) * rest) AS BIGINT) AS tr FROM t),
    {shares('a', '(SELECT tr FROM t2)', 'b', 's')}
    SELECT row_id, h.label, CASE WHEN r <= a.n - a.s THEN 'test' WHEN r <= a.n - b.s THEN 'val' ELSE 'train' END AS split
    FROM h JOIN a ON h.label = a.label JOIN b ON h.label = b.label""")
def split3(spark, folder):
    return split.stratified_split(flow(spark, folder), "label", "row_id", 0.7, 0.2, 0.1).select("row_id", "label", "split")


@query("holdout", f"""WITH {FLOW_SQL}, {ranked('flow', 42)}, {COUNTS},
    t AS (SELECT CAST(sum(n) - ceil(15e-2 * sum(n)) AS BIGINT) AS rest FROM c), {shares('c', '(SELECT rest FROM t)', 'a')}
    SELECT row_id, h.label, CASE WHEN r <= a.n - a.s THEN 'test' ELSE 'train' END AS split FROM h JOIN a ON h.label = a.label""")
def holdout(spark, folder):
    return split.two_way_split(flow(spark, folder), "label", "row_id", 0.15).select("row_id", "label", "split")


FOLDS = "fd AS (SELECT row_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5('42|' || row_id)) AS INT) AS fold FROM flow)"


@query("folds", f"WITH {FLOW_SQL}, {FOLDS} SELECT row_id, label, fold FROM fd")
def folds(spark, folder):
    return split.stratified_folds(flow(spark, folder), "label", "row_id", 5).select("row_id", "label", "fold")


@query("inner_split", f"""WITH {FLOW_SQL}, {FOLDS}, o AS (SELECT row_id, label FROM fd WHERE fold <> 2), {ranked('o', 44)},
    c AS (SELECT label, count(*) AS n FROM o GROUP BY label),
    t AS (SELECT CAST(sum(n) - ceil(15e-2 / (7e-1 + 15e-2) * sum(n)) AS BIGINT) AS rest FROM c),
    {shares('c', '(SELECT rest FROM t)', 'a')}
    SELECT row_id, h.label, CASE WHEN r <= a.n - a.s THEN 'val' ELSE 'train' END AS split FROM h JOIN a ON h.label = a.label""")
def inner_split(spark, folder):
    folded = split.stratified_folds(flow(spark, folder), "label", "row_id", 5)
    return split.inner_split(folded, "label", "row_id", 2, 0.7, 0.15, 42).select("row_id", "label", "split")


@query("undersample", f"""WITH {FLOW_SQL}, {ranked('flow', 42)}, {COUNTS}
    SELECT row_id, label FROM h WHERE r <= (SELECT min(n) FROM c)""")
def undersample(spark, folder):
    return split.undersample(flow(spark, folder).select("row_id", "label"), "label", "row_id")


@query("oversample", f"""WITH {FLOW_SQL}, {ranked('flow', 42)}, {COUNTS},
    s AS (SELECT label, n, (SELECT max(n) FROM c) - n AS lacking FROM c),
    q AS (SELECT label, n, unnest(range(lacking)) AS k FROM s WHERE lacking > 0),
    dr AS (SELECT label, CAST('0x' || substr(md5('42|' || label || '|' || k), 1, 15) AS BIGINT) % n + 1 AS r, k FROM q)
    SELECT row_id, label, CAST(0 AS BIGINT) AS draw FROM flow UNION ALL
    SELECT h.row_id, h.label, row_number() OVER (PARTITION BY h.label, h.r ORDER BY k) AS draw
    FROM dr JOIN h ON h.label = dr.label AND h.r = dr.r""")
def oversample(spark, folder):
    return split.oversample(flow(spark, folder).select("row_id", "label"), "label", "row_id")


@query("class_weights", f"""WITH {FLOW_SQL}, {COUNTS} SELECT label,
    round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def class_weights(spark, folder):
    weights = split.class_weights(flow(spark, folder), "label")
    return rounded(local_table(spark, list(weights.items()), "label int, weight double"))


@query("weighted_rows", f"""WITH {FLOW_SQL}, {COUNTS} SELECT flow.label,
    count(*) AS n, round(sum(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n)), 3) AS weight
    FROM flow JOIN c ON flow.label = c.label GROUP BY flow.label""")
def weighted_rows(spark, folder):
    rows = flow(spark, folder)
    weight = split.weight_column("label", split.class_weights(rows, "label"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(weight).alias("weight")), 3)
