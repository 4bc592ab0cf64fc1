"""Registry and the views that give the driver tables the shape of flow data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]

# Projections that read the same in both engines.
ROW_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id"
FLOW = [
    ROW_ID,
    "l_orderkey",
    "l_linestatus",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "CAST(l_linenumber AS DOUBLE) AS l_linenumber",
    "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS label",
    "round(5e-1 * l_quantity / 5e1 + 5e-1 * l_discount / 1e-1, 6) AS p",
]
DIRTY = [
    ROW_ID,
    "l_orderkey",
    "CAST(l_quantity AS STRING) AS quantity_text",
    "CASE WHEN l_orderkey % 17 = 0 THEN 'Infinity' WHEN l_orderkey % 19 = 0 THEN '' "
    "WHEN l_orderkey % 23 = 0 THEN 'abc' ELSE CAST(l_extendedprice AS STRING) END AS price_text",
    "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_discount END AS discount",
    "CASE l_orderkey % 4 WHEN 0 THEN 'Benign' WHEN 1 THEN 'BENIGN' WHEN 2 THEN ' DDoS' END AS label_text",
    "l_quantity AS quantity",
    "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS label",
]
NET = [
    ROW_ID,
    "l_partkey AS src_port",
    "l_suppkey AS dst_port",
    "l_returnflag AS protocol",
    "l_extendedprice AS bytes_sent",
    "l_quantity AS bytes_received",
]

FLOW_SQL = f"flow AS (SELECT {', '.join(FLOW)} FROM lineitem)"
DIRTY_SQL = (
    f"d0 AS (SELECT {', '.join(DIRTY)} FROM lineitem), "
    "dirty AS (SELECT *, CAST(0 AS INT) AS copy FROM d0 UNION ALL SELECT *, CAST(1 AS INT) AS copy FROM d0 "
    "WHERE l_orderkey % 11 = 0)"
)
# Numbers of the dirty view after lenient coercion.
NUMERIC_SQL = (
    DIRTY_SQL + ", num AS MATERIALIZED (SELECT row_id, copy, quantity, CASE WHEN isfinite(TRY_CAST(trim(price_text) AS DOUBLE)) "
    "THEN TRY_CAST(trim(price_text) AS DOUBLE) END AS price, discount, label FROM dirty)"
)
NET_SQL = f"net AS (SELECT {', '.join(NET)} FROM lineitem)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flow(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*FLOW)


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "lineitem").selectExpr(*DIRTY)
    copies = F.when(F.col("l_orderkey") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("copy", F.explode(copies))


def numeric(spark: SparkSession, folder: str) -> DataFrame:
    from flowspark.functions.expr import parse_number

    return dirty(spark, folder).select(
        "row_id", "copy", "quantity", parse_number(F.col("price_text")).alias("price"), "discount", "label"
    )


def net(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*NET)


def decided(spark: SparkSession, folder: str, threshold: float = 0.5) -> DataFrame:
    from flowspark.functions.expr import decide

    return flow(spark, folder).withColumn("prediction", decide(F.col("p"), threshold))


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round every DOUBLE column, so that summation order does not show."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(F.col(n), other.get(n, digits)) for n in names})


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return function

    return register
