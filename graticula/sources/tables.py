"""Tables by name, and the roles that the driver's tables play: fields, points, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.sources.schema import FIELD_KEYS


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lineitem_field(spark: SparkSession, sf_dir: str, variables: tuple[str, ...] = ("l_extendedprice",)) -> DataFrame:
    """lineitem as a field: points are orders, levels are line numbers; every tenth order is a replica (ghost)."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *variables)
    values = F.posexplode(F.array(*(F.col(v) for v in variables))).alias("var", "value")
    out = rows.select(F.col("l_orderkey").alias("gidx"), F.col("l_linenumber").alias("lev"), values)
    return out.withColumn("ghost", F.col("gidx") % 10 == 0).select(*FIELD_KEYS, "value", "ghost")


def order_points(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """orders as points on the sphere: coordinates are fixed expressions of the key, so SQL can repeat them."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(
        key.alias("gidx"),
        ((key * 37) % 360).cast("double").alias("lon"),
        ((key * 17) % 179 - 89).cast("double").alias("lat"),
        (key % parts).cast("int").alias("part"),
        F.col("o_totalprice").alias("value"),
    )


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(
        key.alias("gidx"), ((key * 53) % 360 + 0.25).alias("lon"), ((key * 29) % 178 - 88.5).alias("lat"), F.col("c_acctbal").alias("value")
    )


#: The SQL of the same roles, for the oracles.
FIELD_SQL = "(SELECT l_orderkey AS gidx, l_linenumber AS lev, l_extendedprice AS value, l_orderkey % 10 = 0 AS ghost FROM lineitem)"
POINTS_SQL = "(SELECT o_orderkey AS gidx, ((o_orderkey * 37) % 360)::DOUBLE AS lon, ((o_orderkey * 17) % 179 - 89)::DOUBLE AS lat, (o_orderkey % 4)::INT AS part, o_totalprice AS value FROM orders)"
CUSTOMERS_SQL = "(SELECT c_custkey AS gidx, (c_custkey * 53) % 360 + 0.25::DOUBLE AS lon, (c_custkey * 29) % 178 - 88.5::DOUBLE AS lat, c_acctbal AS value FROM customer)"
