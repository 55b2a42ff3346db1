"""Statistics of fields in long form (gidx, lev, var, value, ghost).

Sums and means count owned rows only; extremes look at all rows, replicas included. Deviations are population ones. All of it is partial
and final aggregation, so a level with most rows is no bottleneck; one pass with grouping sets gives all granularities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.sources.tables import FIELD_SQL, lineitem_field, order_points, table

def owned(value: Column | str = "value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.col("ghost"), value)


def total(field: DataFrame, *by: str) -> DataFrame:
    """sum and n over owned rows."""
    return field.groupBy(*by).agg(F.sum(owned()).alias("total"), F.count(owned()).alias("n"))


def extremes(field: DataFrame, *by: str) -> DataFrame:
    """low and high over all rows, replicas too."""
    return field.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def locations(field: DataFrame, *by: str) -> DataFrame:
    """Extremes and where they are: ties go to the lowest gidx, then the lowest level."""
    at = [c for c in ("gidx", "lev") if c not in by]
    low = F.min(F.struct("value", *at))
    high = F.max(F.struct("value", *((-F.col(c)).alias(c) for c in at)))
    out = field.groupBy(*by).agg(low.alias("a"), high.alias("b"))
    return out.select(
        *by, F.col("a.value").alias("low"), *(F.col(f"a.{c}").alias(f"low_{c}") for c in at), F.col("b.value").alias("high"), *((-F.col(f"b.{c}")).alias(f"high_{c}") for c in at)
    )


def moments(field: DataFrame, *by: str) -> DataFrame:
    """mean and population standard deviation over owned rows, and their number."""
    return field.groupBy(*by).agg(F.avg(owned()).alias("mean"), F.stddev_pop(owned()).alias("stddev"), F.count(owned()).alias("n"))


def exact_total(field: DataFrame, *by: str) -> DataFrame:
    """A sum that does not depend on the order of rows, for values of any size.

    Values are taken by bands of 32 powers of two. Those of a band, brought between 1 and 2 ** 32 without a loss, are summed as decimals, and
    the few bands of a group are added from the smallest on. A NaN, or infinities of both signs, make the sum NaN; infinities of one sign make it
    infinite.
    """
    whole, inf = owned(), float("inf")
    value = F.when(~F.isnan(whole) & (F.abs(whole) < inf), whole)
    band = F.when(value != 0, F.floor(F.log2(F.abs(value)) / 32)).otherwise(0).cast("int")
    unit = F.pow(F.lit(2.0), F.col("__band") * 16)  # twice: 2 ** (32 band) alone may be no double
    scaled = (F.col("__value") / unit / unit).cast("decimal(34,16)")
    rows = field.withColumns({"__value": value, "__whole": whole, "__band": band})
    # what is not finite, and nulls, in the band of 0
    special = {"__nan": F.isnan("__whole"), "__up": F.col("__whole") == inf, "__down": F.col("__whole") == -inf}
    bands = rows.groupBy(*by, "__band").agg(F.sum(scaled).cast("double").alias("__sum"), F.count("__whole").alias("__n"), *(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in special.items()))
    parts = F.sort_array(F.collect_list(F.when(F.col("__n") > 0, F.struct("__band", (F.coalesce("__sum", F.lit(0.0)) * unit * unit).alias("v")))))  # some 70 bands at most
    nan, up, down = (F.bool_or(n) for n in special)
    total = F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(inf)).when(down, F.lit(-inf))
    total = total.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["v"]))
    return bands.groupBy(*by).agg(total.alias("total"), F.sum("__n").alias("n"))


def summary(field: DataFrame) -> DataFrame:
    """All granularities at once: (), (var), (lev, var), told apart by level_set."""
    sets = field.withColumn("owned", owned()).groupingSets([[], ["var"], ["lev", "var"]], "lev", "var")
    return sets.agg(
        F.grouping_id().cast("long").alias("level_set"), F.sum("owned").alias("total"), F.count("owned").alias("n"), F.avg("owned").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))))


def load_balance(points: DataFrame, part: str = "part") -> DataFrame:
    counts = points.groupBy(part).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("points"))


def timings(spans: DataFrame, *by: str, seconds: str = "seconds") -> DataFrame:
    """count, sum, min, max and variance of traced times by place."""
    s = F.col(seconds)
    return spans.groupBy(*by).agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.min(s).alias("low"), F.max(s).alias("high"), F.var_pop(s).alias("variance"))


def checksum(field: DataFrame, columns: list[str]) -> DataFrame:
    """A checksum of rows that does not depend on their partitions: row hashes (crc32), added up and combined by xor."""
    h = F.crc32(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).cast("binary"))
    return field.select(h.alias("h")).agg(F.sum("h").alias("added"), F.bit_xor("h").alias("mixed"), F.count("*").alias("n"))


def fletcher16(values: list[int]) -> int:
    """The checksum of a list of bytes: two running sums modulo 255."""
    a = b = 0
    for v in values:
        a = (a + v) % 255
        b = (b + a) % 255
    return (b << 8) | a


def ordered_fletcher(field: DataFrame, order: str = "gidx", value: str = "value") -> DataFrame:
    """Fletcher-16 over integer byte values in the order of a key, as a sum of ranks: position p of n counts its byte n - p times.

    The rank is a running number by key ranges, so no task sees all rows; both sums are algebraic.
    """
    from graticula.operators.exchange import running  # exchange needs this module

    rows = field.select(F.col(order).alias("k"), F.col(value).cast("long").alias("v"), F.lit(1).alias("one"))
    ranked = running(rows, "k", "one", "p")
    n = F.count("*")
    first, second = F.sum(F.col("v") % 255) % 255, (n * F.sum(F.col("v") % 255) - F.sum(F.col("p") * (F.col("v") % 255))) % 255
    return ranked.agg((second * 256 + first).alias("fletcher"))


def _r(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _field(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_field(spark, d)


def _variables(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_field(spark, d, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def stats_per_level(spark: SparkSession, d: str) -> DataFrame:
    f = _field(spark, d)
    out = f.groupBy("lev").agg(
        F.sum(owned()).alias("total"), F.avg(owned()).alias("mean"), F.stddev_pop(owned()).alias("stddev"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(owned()).alias("n")
    )
    return _r(out, 2)


def _extremes(s: SparkSession, d: str, *by: str) -> DataFrame:
    """Sums over values that a running sum would lose or spoil: huge ones that cancel beside tiny ones (0), tiny ones (1), a NaN in each order of 500 (2), infinities of one (3) and both signs (4)."""
    q, key = F.col("value"), F.col("gidx")
    values = {0: [F.lit(1e20), q / 4096, F.lit(-1e20), F.lit(1e300), F.lit(-1e300)], 1: [q * 2.0**-40, F.lit(None).cast("double")], 2: [F.when(key % 500 == 7, float("nan")).otherwise(q)]}
    values |= {3: [F.when(key % 500 == 7, float("inf")).otherwise(q)], 4: [F.when(key % 500 < 2, float("inf")).when(key % 500 < 4, float("-inf")).otherwise(q)]}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("var"), v.alias("value")) for k, x in values.items() for v in x))).alias("e")
    f = lineitem_field(s, d, ("l_quantity",)).select("gidx", "lev", "ghost", each).select("gidx", "lev", "ghost", "e.*")
    out = exact_total(f, *by, "var")
    kind = F.when(F.isnan("total"), "nan").when(F.col("total") == float("inf"), "inf").otherwise("finite")
    return out.select(*by, "var", kind.alias("kind"), F.when(kind == "finite", F.round(F.col("total") * F.when(F.col("var") == 1, 2.0**40).otherwise(1.0), 6)).alias("total"), "n")


def _extremes_sql(by: str) -> str:
    rows = "SELECT l_orderkey AS k, l_linenumber AS lev, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 <> 0"
    kinds = "CASE WHEN var = 2 AND bool_or(k % 500 = 7) THEN 'nan' WHEN var = 3 AND bool_or(k % 500 = 7) THEN 'inf' WHEN var = 4 AND bool_or(k % 500 < 2) AND bool_or(k % 500 IN (2, 3)) THEN 'nan' WHEN var = 4 AND bool_or(k % 500 < 2) THEN 'inf' WHEN var = 4 AND bool_or(k % 500 IN (2, 3)) THEN '-inf' ELSE 'finite' END"
    return f"SELECT {by}var, kind, CASE WHEN kind = 'finite' THEN round(q / CASE WHEN var = 0 THEN 4096 ELSE 1 END, 6) END AS total, n * CASE WHEN var = 0 THEN 5 ELSE 1 END AS n FROM (SELECT {by}var, {kinds} AS kind, sum(q::DECIMAL(20,2))::DOUBLE AS q, count(*) AS n FROM ({rows}), (SELECT unnest([0,1,2,3,4])::INT AS var) GROUP BY {by}var)"


_VARS = "(SELECT l_orderkey AS gidx, l_linenumber AS lev, u.var::INT AS var, u.value AS value, l_orderkey % 10 = 0 AS ghost FROM lineitem, LATERAL (SELECT unnest([0,1,2,3]) AS var, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value) u)"

QUERIES = {
    "ag_stats_per_level": stats_per_level,
    "ag1_sum": lambda s, d: _r(total(_field(s, d)), 2),
    "ag1_sum_vector": lambda s, d: _r(total(_variables(s, d), "var"), 2),
    "ag2_sum_per_level": lambda s, d: _r(total(_field(s, d), "lev", "var"), 2),
    "ag3_order_independent_sum": lambda s, d: _r(exact_total(_field(s, d)), 2),
    "ag4_order_independent_sum_per_level": lambda s, d: _r(exact_total(_field(s, d), "lev", "var"), 2),
    "ag3_sum_of_extreme_values": _extremes,
    "ag4_sum_of_extreme_values_per_level": lambda s, d: _extremes(s, d, "lev"),
    "ag5_min_max": lambda s, d: extremes(_field(s, d)),
    "ag6_min_max_per_level": lambda s, d: extremes(_field(s, d), "lev", "var"),
    "ag7_locations": lambda s, d: locations(_field(s, d)),
    "ag8_locations_per_level": lambda s, d: locations(_field(s, d), "lev"),
    "ag9_mean": lambda s, d: _r(moments(_field(s, d)).select("mean", "n")),
    "ag10_mean_per_level": lambda s, d: _r(moments(_field(s, d), "lev").select("lev", "mean", "n")),
    "ag11_mean_stddev": lambda s, d: _r(moments(_variables(s, d), "var")),
    "ag12_mean_stddev_per_level": lambda s, d: _r(moments(_variables(s, d), "lev", "var")),
    "ag14_bounding_box": lambda s, d: bounding_box(order_points(s, d)),
    "ag15_load_balance": lambda s, d: load_balance(order_points(s, d)),
    "ag16_timings": lambda s, d: _r(timings(table(s, d, "events", "event_type", "value"), "event_type", seconds="value"), 4),
    "ag_summary_grouping_sets": lambda s, d: _r(summary(_variables(s, d)), 2),
    "chk1_checksum": lambda s, d: ordered_fletcher(order_points(s, d).withColumn("value", F.col("gidx") % 251)),
}
_N = "count(*) FILTER (NOT ghost) AS n"
ORACLES = {
    "ag_stats_per_level": f"SELECT lev, round(sum(value) FILTER (NOT ghost), 2) AS total, round(avg(value) FILTER (NOT ghost), 2) AS mean, round(stddev_pop(value) FILTER (NOT ghost), 2) AS stddev, min(value) AS low, max(value) AS high, {_N} FROM {FIELD_SQL} GROUP BY lev",
    "ag1_sum": f"SELECT round(sum(value) FILTER (NOT ghost), 2) AS total, {_N} FROM {FIELD_SQL}",
    "ag1_sum_vector": f"SELECT var, round(sum(value) FILTER (NOT ghost), 2) AS total, {_N} FROM {_VARS} GROUP BY var",
    "ag2_sum_per_level": f"SELECT lev, 0 AS var, round(sum(value) FILTER (NOT ghost), 2) AS total, {_N} FROM {FIELD_SQL} GROUP BY lev",
    "ag3_order_independent_sum": f"SELECT round(sum(value::DECIMAL(30,6)) FILTER (NOT ghost)::DOUBLE, 2) AS total, {_N} FROM {FIELD_SQL}",
    "ag4_order_independent_sum_per_level": f"SELECT lev, 0 AS var, round(sum(value::DECIMAL(30,6)) FILTER (NOT ghost)::DOUBLE, 2) AS total, {_N} FROM {FIELD_SQL} GROUP BY lev",
    "ag3_sum_of_extreme_values": _extremes_sql(""),
    "ag4_sum_of_extreme_values_per_level": _extremes_sql("lev, "),
    "ag5_min_max": f"SELECT min(value) AS low, max(value) AS high FROM {FIELD_SQL}",
    "ag6_min_max_per_level": f"SELECT lev, 0 AS var, min(value) AS low, max(value) AS high FROM {FIELD_SQL} GROUP BY lev",
    "ag7_locations": f"WITH f AS {FIELD_SQL} SELECT * FROM (SELECT value AS low, gidx AS low_gidx, lev AS low_lev FROM f ORDER BY value, gidx, lev LIMIT 1), (SELECT value AS high, gidx AS high_gidx, lev AS high_lev FROM f ORDER BY value DESC, gidx, lev LIMIT 1)",
    "ag8_locations_per_level": f"WITH f AS {FIELD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lev ORDER BY value, gidx) AS a, row_number() OVER (PARTITION BY lev ORDER BY value DESC, gidx) AS b FROM f) SELECT x.lev, x.value AS low, x.gidx AS low_gidx, y.value AS high, y.gidx AS high_gidx FROM r x JOIN r y ON x.lev = y.lev AND x.a = 1 AND y.b = 1",
    "ag9_mean": f"SELECT round(avg(value) FILTER (NOT ghost), 4) AS mean, {_N} FROM {FIELD_SQL}",
    "ag10_mean_per_level": f"SELECT lev, round(avg(value) FILTER (NOT ghost), 4) AS mean, {_N} FROM {FIELD_SQL} GROUP BY lev",
    "ag11_mean_stddev": f"SELECT var, round(avg(value) FILTER (NOT ghost), 4) AS mean, round(stddev_pop(value) FILTER (NOT ghost), 4) AS stddev, {_N} FROM {_VARS} GROUP BY var",
    "ag12_mean_stddev_per_level": f"SELECT lev, var, round(avg(value) FILTER (NOT ghost), 4) AS mean, round(stddev_pop(value) FILTER (NOT ghost), 4) AS stddev, {_N} FROM {_VARS} GROUP BY lev, var",
    "ag14_bounding_box": "SELECT min((o_orderkey * 37) % 360)::DOUBLE AS min_lon, max((o_orderkey * 37) % 360)::DOUBLE AS max_lon, min((o_orderkey * 17) % 179 - 89)::DOUBLE AS min_lat, max((o_orderkey * 17) % 179 - 89)::DOUBLE AS max_lat FROM orders",
    "ag15_load_balance": "SELECT count(*) AS parts, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS points FROM (SELECT o_orderkey % 4 AS p, count(*) AS n FROM orders GROUP BY p)",
    "ag16_timings": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS low, round(max(value), 4) AS high, round(var_pop(value), 4) AS variance FROM events GROUP BY event_type",
    "ag_summary_grouping_sets": f"SELECT lev, var, grouping_id(lev, var)::BIGINT AS level_set, round(sum(value) FILTER (NOT ghost), 2) AS total, {_N}, round(avg(value) FILTER (NOT ghost), 2) AS mean, round(min(value), 2) AS low, round(max(value), 2) AS high FROM {_VARS} GROUP BY GROUPING SETS ((), (var), (lev, var))",
    "chk1_checksum": "WITH v AS (SELECT (o_orderkey % 251) % 255 AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) SELECT ((sum((n - p) * v) % 255) * 256 + sum(v) % 255)::BIGINT AS fletcher FROM v",
}
