"""Sparse matrices as rows (row, col, w): products, transposes, weights applied to fields, and missing-value policies.

A product is a join on the column and a sum by row, with partial aggregation before the shuffle; duplicates of an entry add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.operators.exchange import running
from graticula.sources.tables import table


def apply(weights: DataFrame, field: DataFrame, by: tuple[str, ...] = (), rows: DataFrame | None = None, value: str = "value") -> DataFrame:
    """y = W x for each group of `by`: (row, *by, value). rows: all row numbers, of which those without entries give 0."""
    out = weights.join(field.withColumnRenamed("gidx", "col"), "col").groupBy("row", *by).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    if rows is not None:
        out = rows.join(out, "row", "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    return out


def apply_add(weights: DataFrame, field: DataFrame, target: DataFrame, value: str = "value") -> DataFrame:
    """y += W x."""
    product = apply(weights, field)
    return target.unionByName(product).groupBy("row").agg(F.sum(value).alias(value))


def transpose(weights: DataFrame) -> DataFrame:
    return weights.select(F.col("col").alias("row"), F.col("row").alias("col"), "w")


def adjoint(weights: DataFrame, field: DataFrame, value: str = "value") -> DataFrame:
    """x = W^T y: the same weights, columns swapped."""
    return apply(transpose(weights), field, value=value)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """C = A B of entry rows."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("to"), F.col("w").alias("v"))
    return a.join(right, "col").groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))


def compressed(weights: DataFrame) -> DataFrame:
    """Rows of a compressed matrix: each row's columns and weights, ordered, and the offset of its first entry."""
    rows = weights.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "w"))).alias("entries"), F.count("*").alias("n"))
    return running(rows, "row", "n", "offset").select("row", "n", "offset", "entries")


def normalised(weights: DataFrame) -> DataFrame:
    return weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("row")))


def is_missing(value: Column, kind: str, marker: float = 0.0, eps: float = 0.0) -> Column:
    """Missing by `nan`, `equals` or `approximately-equals`."""
    if kind == "nan":
        return F.isnan(value)
    if kind == "equals":
        return value == marker
    if kind == "approximately-equals":
        return F.abs(value - marker) <= eps
    raise ValueError(f"unknown kind of missing value: {kind}")


def apply_missing(weights: DataFrame, field: DataFrame, missing: Column, policy: str, marker: float, by: tuple[str, ...] = ()) -> DataFrame:
    """W x where some values are missing.

    missing-if-all-missing: missing entries are left out and the others' weights scaled to 1. missing-if-any-missing: one missing entry is
    enough. missing-if-heaviest-missing: as the first, but missing if the heaviest entry (the first of them by column) is.
    """
    joined = weights.join(field.withColumnRenamed("gidx", "col"), "col").withColumn("__m", missing)
    heaviest = F.max_by("__m", F.struct("w", -F.col("col")))
    g = joined.groupBy("row", *by).agg(
        F.sum(F.when(~F.col("__m"), F.col("w") * F.col("value"))).alias("__s"),
        F.sum(F.when(~F.col("__m"), F.col("w"))).alias("__w"),
        F.sum(F.col("w") * F.when(F.col("__m"), F.lit(None)).otherwise(F.col("value"))).alias("__plain"),
        F.max("__m").alias("__any"),
        heaviest.alias("__heavy"),
    )
    scaled = F.when(~F.col("__any"), F.col("__plain")).when(F.abs(F.col("__w")) > 1e-14, F.col("__s") / F.col("__w")).otherwise(F.lit(marker))
    value = {
        "missing-if-all-missing": scaled,
        "missing-if-any-missing": F.when(F.col("__any"), F.lit(marker)).otherwise(F.col("__plain")),
        "missing-if-heaviest-missing": F.when(F.col("__heavy"), F.lit(marker)).otherwise(scaled),
    }[policy]
    return g.select("row", *by, value.alias("value"))


def with_failed(result: DataFrame, targets: DataFrame, marker: float = 9999.0) -> DataFrame:
    """Targets that no weight reaches get the marker."""
    return targets.join(result, "row", "left").withColumn("value", F.coalesce("value", F.lit(marker)))


def _w(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("w"))


def _x(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("gidx"), F.col("p_retailprice").alias("value"))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return _x(s, d).withColumn("lev", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") * F.col("lev"))


def _round(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("value", F.round("value", digits))


def _missing(policy: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return _round(apply_missing(_w(s, d), _x(s, d).withColumn("value", F.when(F.col("gidx") % 3 == 0, F.lit(-1.0)).otherwise(F.col("value"))), is_missing(F.col("value"), "equals", -1.0), policy, -1.0), 8)

    return query


_orders = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("row"))
_MISS = """WITH j AS (SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS w, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT row, sum(w*v) AS s, sum(CASE WHEN v IS NOT NULL THEN w END) AS sw, bool_or(v IS NULL) AS any_, (arg_max(CASE WHEN v IS NULL THEN 1 ELSE 0 END, (w, -col))) = 1 AS heavy FROM j GROUP BY row)"""
_SCALED = "CASE WHEN NOT any_ THEN s WHEN sw > 0 THEN s/sw ELSE -1.0 END"
_J = "lineitem JOIN part ON p_partkey = l_partkey"
QUERIES = {
    "la1_apply": lambda s, d: _round(apply(_w(s, d), _x(s, d))),
    "la1_apply_levels": lambda s, d: _round(apply(_w(s, d), _levels(s, d), ("lev",))),
    "la1_apply_all_rows": lambda s, d: _round(apply(_w(s, d), _x(s, d), rows=_orders(s, d))),
    "la2_apply_add": lambda s, d: _round(apply_add(_w(s, d), _x(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("value")))),
    "la3_compressed": lambda s, d: compressed(_w(s, d)).select("row", "n", "offset", F.col("entries")[0]["col"].alias("first")),
    "la5_transpose": lambda s, d: transpose(_w(s, d)),
    "la6_matmul": lambda s, d: matmul(
        table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("row"), (F.col("c_custkey") % 50).alias("col"), F.lit(1.0).alias("w")),
        table(s, d, "supplier").select((F.col("s_suppkey") % 50).alias("row"), F.col("s_nationkey").cast("long").alias("col"), F.lit(2.0).alias("w")),
    ),
    "so4_sorted_entries": lambda s, d: _w(s, d).orderBy("row", "col"),
    "in19_execute": lambda s, d: _round(apply(normalised(_w(s, d)), _x(s, d).withColumn("value", F.sqrt("value"))), 6),
    "in20_execute_adjoint": lambda s, d: _round(adjoint(_w(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("gidx"), F.col("o_totalprice").alias("value")))),
    "in21_missing_if_all": _missing("missing-if-all-missing"),
    "in21_missing_if_any": _missing("missing-if-any-missing"),
    "in21_missing_if_heaviest": _missing("missing-if-heaviest-missing"),
    "in22_failed_points": lambda s, d: _round(with_failed(apply(_w(s, d), _x(s, d)), _orders(s, d))),
    "f5_missing_approximately": lambda s, d: table(s, d, "orders").select("o_orderkey", is_missing(F.col("o_totalprice"), "approximately-equals", 50000.0, 30000.0).alias("missing")),
}
ORACLES = {
    "la1_apply": f"SELECT l_orderkey AS row, round(sum(l_quantity*p_retailprice),2) AS value FROM {_J} GROUP BY 1",
    "la1_apply_levels": f"SELECT l_orderkey AS row, lev::INT AS lev, round(sum(l_quantity*p_retailprice*lev),2) AS value FROM {_J}, (SELECT unnest([1,2]) AS lev) GROUP BY 1, 2",
    "la1_apply_all_rows": f"SELECT o_orderkey AS row, coalesce(v, 0.0) AS value FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity*p_retailprice),2) AS v FROM {_J} GROUP BY 1) ON l_orderkey = o_orderkey",
    "la2_apply_add": f"SELECT row, round(sum(value),2) AS value FROM (SELECT o_orderkey AS row, o_totalprice AS value FROM orders UNION ALL SELECT l_orderkey, l_quantity*p_retailprice FROM {_J}) GROUP BY row",
    "la3_compressed": "SELECT row, n, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS \"offset\", first FROM (SELECT l_orderkey AS row, count(*) AS n, min(l_partkey) AS first FROM lineitem GROUP BY 1)",
    "la5_transpose": "SELECT l_partkey AS row, l_orderkey AS col, l_quantity AS w FROM lineitem",
    "la6_matmul": "SELECT c_nationkey::BIGINT AS row, s_nationkey::BIGINT AS col, count(*)*2.0::DOUBLE AS w FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50 GROUP BY 1, 2",
    "so4_sorted_entries": "SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS w FROM lineitem",
    "in19_execute": f"SELECT l_orderkey AS row, round(sum(l_quantity*sqrt(p_retailprice))/sum(l_quantity),6) AS value FROM {_J} GROUP BY 1",
    "in20_execute_adjoint": "SELECT l_partkey AS row, round(sum(l_quantity*o_totalprice),2) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "in21_missing_if_all": f"{_MISS} SELECT row, round({_SCALED},8) AS value FROM g",
    "in21_missing_if_any": f"{_MISS} SELECT row, round(CASE WHEN any_ THEN -1.0 ELSE s END,8) AS value FROM g",
    "in21_missing_if_heaviest": f"{_MISS} SELECT row, round(CASE WHEN heavy THEN -1.0 ELSE {_SCALED} END,8) AS value FROM g",
    "in22_failed_points": f"SELECT o_orderkey AS row, coalesce(v, 9999.0) AS value FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity*p_retailprice),2) AS v FROM {_J} GROUP BY 1) ON l_orderkey = o_orderkey",
    "f5_missing_approximately": "SELECT o_orderkey, abs(o_totalprice - 50000.0) <= 30000.0 AS missing FROM orders",
}
