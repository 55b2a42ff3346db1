"""Key-based exchange: halo refresh and its adjoint, collect, locate, gather, scatter, redistribution, numbering.

What a message-passing library does with buffers is here an equi-join or an aggregate on the global key; Spark picks broadcast, sort-merge
or skew handling by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.sources.records import scratch
from graticula.sources.tables import order_points, table


def halo_exchange(rows: DataFrame, key: str = "gidx", value: str = "value", ghost: str = "ghost") -> DataFrame:
    """Replicas get their owner's value; a replica without owner keeps its own."""
    owners = rows.filter(~F.col(ghost)).select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.lit(True).alias("__there"))
    joined = rows.join(owners, (F.col(key) == F.col("__key")) & F.col(ghost), "left")
    return joined.withColumn(value, F.when(F.col("__there"), F.col("__value")).otherwise(F.col(value))).drop("__key", "__value", "__there")


def halo_exchange_adjoint(rows: DataFrame, key: str = "gidx", value: str = "value", ghost: str = "ghost") -> DataFrame:
    """Replicas are added into their owner and become 0."""
    sums = rows.filter(F.col(ghost)).groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias("__sum"))
    joined = rows.join(sums, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(value, F.when(F.col(ghost), F.lit(0.0)).otherwise(F.col(value) + F.coalesce("__sum", F.lit(0.0)))).drop("__key", "__sum")


def collect_rows(requests: DataFrame, data: DataFrame, on: list[str]) -> DataFrame:
    """Each request, in any order and any number of times, with the row it asks for (null if there is none)."""
    return requests.join(data, on, "left")


def locate(keys: DataFrame, distribution: DataFrame, key: str = "gidx") -> DataFrame:
    """keys with part and local index; keys that have no home get nulls."""
    return keys.join(distribution, key, "left")


def missing_keys(keys: DataFrame, distribution: DataFrame, key: str = "gidx") -> DataFrame:
    """Keys without a home: a non-empty result is the error that a strict lookup raises."""
    return keys.join(distribution, key, "left_anti")


def local_index(points: DataFrame, part: str = "part", key: str = "gidx") -> DataFrame:
    """remote index: the place of the row's key in its part, from 0, in key order; a part of any size is numbered by ranges."""
    numbers = renumber(points.withColumn("__uid", F.struct(F.col(part).alias("p"), F.col(key).alias("k"))), "__uid", "ridx").drop("__uid")
    starts = numbers.groupBy(part).agg(F.min("ridx").alias("__start"))  # a row for each part
    return numbers.join(F.broadcast(starts), part).withColumn("ridx", F.col("ridx") - F.col("__start")).select(*points.columns, "ridx")


def gather(rows: DataFrame, key: str = "gidx", ghost: str | None = "ghost") -> DataFrame:
    """Owned rows, one for each key, in global order."""
    owned = rows.filter(~F.col(ghost)) if ghost else rows
    return owned.dropDuplicates([key]).orderBy(key)


def scatter(values: DataFrame, distribution: DataFrame, key: str = "gidx") -> DataFrame:
    return values.join(distribution, key)


def redistribute(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the target's part, matched by key: both sides must hold the same keys."""
    return rows.drop("part").join(target.select(*key, "part"), key)


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How many keys only one side has: 0 and 0 allow a redistribution."""
    only_a = a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("only_left"))
    only_b = b.select(*key).distinct().join(a.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("only_right"))
    return only_a.join(only_b)  # one row each


def offsets(counts: DataFrame, group: str, count: str) -> DataFrame:
    """Exclusive prefix sums over a small table of counts."""
    return counts.withColumn("offset", F.sum(count).over(Window.orderBy(group)) - F.col(count))


def renumber(rows: DataFrame, uid: str, new: str = "number") -> DataFrame:
    """Dense numbers from 1 by ascending uid, equal uids alike; rows without a uid have no number and are left out.

    Distinct uids are dealt into as many ranges of equal share as there are shuffle partitions, whatever their values; each range is
    numbered by itself and shifted by the counts before. The ranges are written, so that all that is counted sees the same ones.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "numbering")
    ids = rows.select(uid).dropna().distinct().repartitionByRange(parts, uid)
    ids.withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ids = spark.read.parquet(path)
    sizes = ids.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    sizes = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    ranked = ids.withColumn("__r", F.row_number().over(Window.partitionBy("__range").orderBy(uid))).join(sizes, "__range")
    # numbers take little space in files and shuffles for what they are in memory, so Spark is told not to broadcast them
    return rows.join(ranked.select(uid, (F.col("__before") + F.col("__r")).alias(new)).hint("merge"), uid)


def running(rows: DataFrame, key: str, amount: str, new: str) -> DataFrame:
    """rows with the sum of an amount over all rows before, in the order of a unique key: sums within ranges of equal share, shifted by the sums
    of the ranges before. The ranges are written, as in `renumber`."""
    spark = rows.sparkSession
    path = scratch(spark, "running")
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("__range").agg(F.sum(amount).alias("__n"))  # a row for each range
    sizes = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__r", inside).join(F.broadcast(sizes), "__range").withColumn(new, F.col("__before") + F.col("__r")).drop("__range", "__r", "__before")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def with_replicas(points: DataFrame) -> DataFrame:
    """points, and as ghosts a stale copy of each seventh one in the next part."""
    own = points.withColumn("ghost", F.lit(False))
    copies = points.filter(F.col("gidx") % 7 == 0).withColumn("part", ((F.col("part") + 1) % 4).cast("int")).withColumn("value", F.lit(-1.0)).withColumn("ghost", F.lit(True))
    return own.unionByName(copies)


def _rows(s: SparkSession, d: str) -> DataFrame:
    return with_replicas(order_points(s, d).select("gidx", "part", "value"))


def _requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem", "l_orderkey", "l_linenumber").select(F.monotonically_increasing_id().alias("__i"), F.col("l_orderkey").alias("gidx"), F.col("l_linenumber").alias("pos")).drop("__i")


_ROWS = "(SELECT o_orderkey AS gidx, (o_orderkey % 4)::INT AS part, o_totalprice AS value, FALSE AS ghost FROM orders UNION ALL SELECT o_orderkey, ((o_orderkey % 4 + 1) % 4)::INT, -1.0, TRUE FROM orders WHERE o_orderkey % 7 = 0)"
_OWN = "(SELECT o_orderkey AS gidx, (o_orderkey % 4)::INT AS part, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS ridx FROM orders)"
_dist = lambda s, d: local_index(order_points(s, d)).select("gidx", "part", "ridx")
_other = lambda s, d: order_points(s, d).select("gidx", (F.floor(F.col("gidx") / 100) % 8).cast("int").alias("part"))

QUERIES = {
    "j1_halo_exchange": lambda s, d: halo_exchange(_rows(s, d)),
    "j2_halo_exchange_adjoint": lambda s, d: halo_exchange_adjoint(_rows(s, d)),
    "j3_collect": lambda s, d: collect_rows(_requests(s, d), order_points(s, d).select("gidx", "value", "part"), ["gidx"]),
    "j4_locate_part": lambda s, d: locate(_requests(s, d), order_points(s, d).select("gidx", "part")),
    "j5_locate_index": lambda s, d: locate(_requests(s, d), _dist(s, d).select("gidx", "ridx")),
    "j6_locate_both": lambda s, d: locate(_requests(s, d), _dist(s, d)),
    "j6_missing_keys": lambda s, d: missing_keys(table(s, d, "orders").select((F.col("o_orderkey") + 5).alias("gidx")), _dist(s, d)),
    "j12_redistribute": lambda s, d: redistribute(order_points(s, d).select("gidx", "part", "value"), _other(s, d), ["gidx"]),
    "j12_same_keys": lambda s, d: same_keys(order_points(s, d), _other(s, d).filter("gidx % 5 <> 0"), ["gidx"]),
    "j13_redistribute_structured": lambda s, d: redistribute(
        table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.max("l_extendedprice").alias("value")).withColumn("part", F.lit(0)),
        table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j")).distinct().withColumn("part", ((F.col("i") + F.col("j")) % 3).cast("int")),
        ["i", "j"],
    ),
    "j14_remote_index": lambda s, d: local_index(order_points(s, d)).select("gidx", "part", "ridx"),
    "so5_gather": lambda s, d: gather(_rows(s, d)).select("gidx", "value"),
    "so6_scatter": lambda s, d: scatter(order_points(s, d).select("gidx", "value"), _dist(s, d)),
    "st1_union": lambda s, d: order_points(s, d).select("gidx", "value").unionByName(order_points(s, d).select("gidx", F.col("lon").alias("value"))),
    "st2_intersection": lambda s, d: common(table(s, d, "orders").select(F.col("o_custkey").alias("gidx")), table(s, d, "customer").select(F.col("c_custkey").alias("gidx"))),
    "w3_offsets": lambda s, d: offsets(order_points(s, d).groupBy("part").agg(F.count("*").alias("n")), "part", "n"),
    "w4_renumber": lambda s, d: renumber(table(s, d, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber"), "uid"),
}
ORACLES = {
    "j1_halo_exchange": f"SELECT r.gidx, r.part, CASE WHEN r.ghost THEN o.o_totalprice ELSE r.value END AS value, r.ghost FROM {_ROWS} r JOIN orders o ON o.o_orderkey = r.gidx",
    "j2_halo_exchange_adjoint": f"WITH r AS {_ROWS}, g AS (SELECT gidx, sum(value) AS s FROM r WHERE ghost GROUP BY gidx) SELECT r.gidx, part, CASE WHEN ghost THEN 0.0::DOUBLE ELSE value::DOUBLE + coalesce(s, 0)::DOUBLE END AS value, ghost FROM r LEFT JOIN g ON r.gidx = g.gidx",
    "j3_collect": f"SELECT l_orderkey AS gidx, l_linenumber AS pos, value, part FROM lineitem LEFT JOIN {_OWN} o ON gidx = l_orderkey",
    "j4_locate_part": f"SELECT l_orderkey AS gidx, l_linenumber AS pos, part FROM lineitem LEFT JOIN {_OWN} o ON gidx = l_orderkey",
    "j5_locate_index": f"SELECT l_orderkey AS gidx, l_linenumber AS pos, ridx FROM lineitem LEFT JOIN {_OWN} o ON gidx = l_orderkey",
    "j6_locate_both": f"SELECT l_orderkey AS gidx, l_linenumber AS pos, part, ridx FROM lineitem LEFT JOIN {_OWN} o ON gidx = l_orderkey",
    "j6_missing_keys": "SELECT o_orderkey + 5 AS gidx FROM orders WHERE o_orderkey + 5 NOT IN (SELECT o_orderkey FROM orders)",
    "j12_redistribute": "SELECT o_orderkey AS gidx, o_totalprice AS value, ((o_orderkey // 100) % 8)::INT AS part FROM orders",
    "j12_same_keys": "SELECT count(*) FILTER (o_orderkey % 5 = 0) AS only_left, 0::BIGINT AS only_right FROM orders",
    "j13_redistribute_structured": "SELECT l_orderkey AS i, l_linenumber AS j, max(l_extendedprice) AS value, ((l_orderkey + l_linenumber) % 3)::INT AS part FROM lineitem GROUP BY 1, 2",
    "j14_remote_index": f"SELECT gidx, part, ridx FROM {_OWN}",
    "so5_gather": "SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders",
    "so6_scatter": f"SELECT gidx, value, part, ridx FROM {_OWN}",
    "st1_union": "SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, ((o_orderkey * 37) % 360)::DOUBLE FROM orders",
    "st2_intersection": "SELECT o_custkey AS gidx FROM orders INTERSECT SELECT c_custkey FROM customer",
    "w3_offsets": "SELECT part, n, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS \"offset\" FROM (SELECT (o_orderkey % 4)::INT AS part, count(*) AS n FROM orders GROUP BY 1)",
    "w4_renumber": "SELECT l_orderkey AS uid, l_linenumber, dense_rank() OVER (ORDER BY l_orderkey) AS number FROM lineitem",
}
