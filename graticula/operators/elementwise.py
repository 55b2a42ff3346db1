"""Slices, assignments, masked and column-wise functions, vertical differences and stencils over fields in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.sources.tables import FIELD_SQL, lineitem_field, order_points, table


def sliced(field: DataFrame, **ranges: tuple[int | None, int | None]) -> DataFrame:
    """Rows whose index is in [from, to) in each named dimension; None leaves an end open."""
    for dim, (lo, hi) in ranges.items():
        if lo is not None:
            field = field.filter(F.col(dim) >= lo)
        if hi is not None:
            field = field.filter(F.col(dim) < hi)
    return field


def assigned(field: DataFrame, value: Column | float) -> DataFrame:
    return field.withColumn("value", value if isinstance(value, Column) else F.lit(value))


def inserted(rows: DataFrame, at: int, count: int, index: str = "gidx") -> DataFrame:
    """Room for count rows before index `at`: later rows move up, the new ones have null values."""
    moved = rows.withColumn(index, F.when(F.col(index) >= at, F.col(index) + count).otherwise(F.col(index)))
    new = rows.sparkSession.range(at, at + count).withColumnRenamed("id", index)
    return moved.unionByName(new, allowMissingColumns=True)


def for_each_value(field: DataFrame, f: Callable[..., Column], *inputs: str, out: str = "value") -> DataFrame:
    """out = f(inputs) in each row."""
    return field.withColumn(out, f(*(F.col(c) for c in inputs)))


def for_each_value_masked(field: DataFrame, mask: Column, f: Callable[..., Column], *inputs: str, out: str = "value") -> DataFrame:
    """As for_each_value, but rows where the mask is true keep what they have."""
    return field.withColumn(out, F.when(mask, F.col(out)).otherwise(f(*(F.col(c) for c in inputs))))


def for_each_column(field: DataFrame, f: Callable[[Column], Column], *key: str, order: str = "lev") -> DataFrame:
    """f sees a whole vertical column as an array and gives an array of the same length; columns are short."""
    column = F.sort_array(F.collect_list(F.struct(order, "value")))
    whole = field.groupBy(*key).agg(column.alias("__c")).withColumn("__f", f(F.transform("__c", lambda x: x["value"])))
    zipped = F.transform("__c", lambda x, i: F.struct(x[order].alias(order), F.get("__f", i).alias("value")))
    return whole.select(*key, F.inline(zipped))


def for_each_column_pandas(field: DataFrame, f: Callable[[pd.Series], pd.Series], *key: str, order: str = "lev") -> DataFrame:
    """As for_each_column, for functions that columns cannot express: f maps a pandas Series in vertical order."""
    kinds = dict(field.dtypes)
    keys = field.select(*key).columns
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", __at array<{kinds[order]}>, __values array<{kinds['value']}>"
    # columns travel many to a batch; null orders come last
    entry = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col("value").alias("value"))
    columns = field.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("c")).select(*keys, F.col("c.at").alias("__at"), F.col("c.value").alias("__values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(__values=[f(pd.Series(v)).to_numpy() for v in pdf["__values"]])

    out = columns.mapInPandas(run, schema)
    return out.select(*keys, F.inline(F.arrays_zip(F.col("__at").alias(order), F.col("__values").alias("value"))))


def vertical_difference(field: DataFrame, *key: str, order: str = "lev") -> DataFrame:
    """Centred differences inside a column, one-sided ones at its ends, 0 for a single level."""
    w = Window.partitionBy(*key).orderBy(order)
    up, down = F.lead("value").over(w), F.lag("value").over(w)
    diff = F.when(up.isNotNull() & down.isNotNull(), (up - down) / 2.0).when(up.isNotNull(), up - F.col("value")).when(down.isNotNull(), F.col("value") - down).otherwise(F.lit(0.0))
    return field.withColumn("difference", diff)


def frame(rows: DataFrame, by: str, order: list[str], value: str, before: int, after: int) -> DataFrame:
    """The neighbours of each row in its ordered group: arrays of at most before + 1 + after values."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn("stencil", F.collect_list(value).over(w))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time in the same group: one sort, no range join."""
    both = left.select("*", F.lit(1).alias("__side")).unionByName(right.select(by, at, value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last(F.when(F.col("__side") == 0, F.col(value)), ignorenulls=True).over(w)).filter("__side = 1").drop("__side", value)


def blocked(points: DataFrame, nproma: int, index: str = "gidx") -> DataFrame:
    """Block and place in the block of each point (index from 0)."""
    return points.withColumn("blk", F.floor(F.col(index) / nproma)).withColumn("rof", F.col(index) % nproma)


def _col(s: SparkSession, d: str) -> DataFrame:
    """Columns with distinct levels: the largest price of each (order, line)."""
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("gidx"), F.col("l_linenumber").alias("lev")).agg(F.max("l_extendedprice").alias("value"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events", "event_id", "user_id", "ts", "value", "event_type")


_COL = "(SELECT l_orderkey AS gidx, l_linenumber AS lev, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
QUERIES = {
    "arr1_slice": lambda s, d: sliced(lineitem_field(s, d), lev=(2, 5), gidx=(None, 1000)).select("gidx", "lev", "value"),
    "arr2_assign": lambda s, d: assigned(lineitem_field(s, d), F.col("lev") * 1.5).select("gidx", "lev", "value"),
    "arr3_insert": lambda s, d: inserted(order_points(s, d).select("gidx", "value"), 100, 5),
    "udf1_for_each_value": lambda s, d: for_each_value(lineitem_field(s, d), lambda v, k: v * 2 + k, "value", "lev").select("gidx", "lev", "value"),
    "udf2_for_each_value_masked": lambda s, d: for_each_value_masked(lineitem_field(s, d), F.col("ghost"), lambda v: v * 2, "value").select("gidx", "lev", "value"),
    "udf3_for_each_column": lambda s, d: for_each_column(_col(s, d), lambda a: F.transform(a, lambda x: x - F.get(a, F.lit(0))), "gidx"),
    "udf4_for_each_column_masked": lambda s, d: for_each_column(_col(s, d).filter("gidx % 10 <> 0"), lambda a: F.reverse(a), "gidx").unionByName(_col(s, d).filter("gidx % 10 = 0")),
    "udf3_for_each_column_pandas": lambda s, d: for_each_column_pandas(_col(s, d), lambda v: v.cummax(), "gidx"),
    "udf5_parallel_for": lambda s, d: for_each_value(order_points(s, d), lambda i, x: i * 1000 + x, "gidx", "lon").select("gidx", "value"),
    "w1_stencil_frame": lambda s, d: frame(table(s, d, "supplier", "s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"], "s_suppkey", 1, 2).select("s_suppkey", F.array_join("stencil", ",").alias("stencil")),
    "w2_vertical_difference": lambda s, d: vertical_difference(_col(s, d), "gidx").select("gidx", "lev", F.round("difference", 6).alias("difference")),
    "w5_rank": lambda s, d: table(s, d, "events", "event_id", "user_id", "value").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))).filter("k <= 3").select("user_id", "event_id", "k"),
    "j24_as_of": lambda s, d: as_of(_events(s, d).filter("event_id % 2 = 1").select("event_id", "user_id", "ts"), _events(s, d).filter("event_id % 2 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", "value").select("event_id", "last_value"),
    "pt11_blocks": lambda s, d: blocked(order_points(s, d).select("gidx"), 64),
}
ORACLES = {
    "arr1_slice": f"SELECT gidx, lev, value FROM {FIELD_SQL} WHERE lev >= 2 AND lev < 5 AND gidx < 1000",
    "arr2_assign": f"SELECT gidx, lev, lev*1.5::DOUBLE AS value FROM {FIELD_SQL}",
    "arr3_insert": "SELECT CASE WHEN o_orderkey >= 100 THEN o_orderkey + 5 ELSE o_orderkey END AS gidx, o_totalprice AS value FROM orders UNION ALL SELECT unnest(range(100, 105)), NULL",
    "udf1_for_each_value": f"SELECT gidx, lev, value*2 + lev AS value FROM {FIELD_SQL}",
    "udf2_for_each_value_masked": f"SELECT gidx, lev, CASE WHEN ghost THEN value ELSE value*2 END AS value FROM {FIELD_SQL}",
    "udf3_for_each_column": f"SELECT gidx, lev, value - first_value(value) OVER (PARTITION BY gidx ORDER BY lev) AS value FROM {_COL}",
    "udf4_for_each_column_masked": f"WITH c AS {_COL}, r AS (SELECT *, row_number() OVER (PARTITION BY gidx ORDER BY lev) AS a, row_number() OVER (PARTITION BY gidx ORDER BY lev DESC) AS b FROM c) SELECT x.gidx, x.lev, CASE WHEN x.gidx % 10 = 0 THEN x.value ELSE y.value END AS value FROM r x JOIN r y ON x.gidx = y.gidx AND x.a = y.b",
    "udf3_for_each_column_pandas": f"SELECT gidx, lev, max(value) OVER (PARTITION BY gidx ORDER BY lev) AS value FROM {_COL}",
    "udf5_parallel_for": "SELECT o_orderkey AS gidx, o_orderkey*1000 + ((o_orderkey*37)%360)::DOUBLE AS value FROM orders",
    "w1_stencil_frame": "SELECT s_suppkey, array_to_string(list(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), ',') AS stencil FROM supplier",
    "w2_vertical_difference": f"SELECT gidx, lev, round(CASE WHEN u IS NOT NULL AND p IS NOT NULL THEN (u-p)/2 WHEN u IS NOT NULL THEN u-value WHEN p IS NOT NULL THEN value-p ELSE 0 END, 6) AS difference FROM (SELECT *, lead(value) OVER w AS u, lag(value) OVER w AS p FROM {_COL} WINDOW w AS (PARTITION BY gidx ORDER BY lev))",
    "w5_rank": "SELECT user_id, event_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events) WHERE k <= 3",
    "j24_as_of": "SELECT l.event_id, (SELECT max(r.value) FROM events r WHERE r.user_id = l.user_id AND r.event_id % 2 = 0 AND r.ts = (SELECT max(ts) FROM events q WHERE q.user_id = l.user_id AND q.event_id % 2 = 0 AND q.ts <= l.ts)) AS last_value FROM events l WHERE event_id % 2 = 1",
    "pt11_blocks": "SELECT o_orderkey AS gidx, o_orderkey // 64 AS blk, o_orderkey % 64 AS rof FROM orders",
}
