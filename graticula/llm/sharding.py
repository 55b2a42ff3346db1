"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank - 1/2) / size of the source orders all
rows, and the order is cut into shards of equal row counts, so every shard has the mixture of the whole. Both orders are numbered by
ranges of equal size, so a source with a third of all rows, a row that repeats, and fractions that are equal are numbered by
many tasks. The texts themselves are not shuffled.

Defined cases: a null text counts as 0 bytes and has a null checksum of the empty string, 0; a null source is a source of its own;
null and repeated ids are ordinary rows (ties are ordered by source, hash, id, checksum, size, row); very long texts are read for their
length and checksum only; an empty table gives an empty result; further columns do not take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.common import shuffle_partitions, written


def fractional_ranks(rows: DataFrame, stratum: Column, order: list[Column]) -> DataFrame:
    """rows with rank (from 1, within the stratum by order), stratum_rows and fraction.

    All rows are numbered by (stratum, order); a rank is the number less that of the stratum's first row. The order ends with something that tells all rows apart, so
    neither a large stratum nor a row that repeats is one range.
    """
    placed = positions(rows.withColumn("__s", stratum), [F.col("__s"), *order]).drop("total")
    placed = written(placed.withColumnRenamed("position", "__p"), "shard-ranks")
    # one row for each stratum, as a table: its size is known when the join is planned, and AQE can cut a large stratum
    sums = written(placed.groupBy("__s").agg(F.min("__p").alias("__first"), F.count("*").alias("stratum_rows")), "shard-strata")
    out = placed.join(sums, "__s").withColumn("rank", F.col("__p") - F.col("__first") + 1)
    return out.withColumn("fraction", (F.col("rank") - 0.5) / F.col("stratum_rows")).drop("__s", "__p", "__first")


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with position (from 0, by order) and total (the number of rows).

    Ranges of the whole order, ties included, are numbered apart: as many as there are shuffle partitions, with equal shares of the rows.
    """
    parts = shuffle_partitions(rows.sparkSession)
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "shard-ranges")
    everything = Window.orderBy("__part")  # a row for each range
    sums = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    sums = sums.select(
        "__part",
        (F.sum("__n").over(everything) - F.col("__n")).alias("__before"),
        F.sum("__n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    ranked = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return ranked.join(sums, "__part").withColumn("position", F.col("__before") + F.col("__rn") - 1).drop("__part", "__before", "__rn")


def interleave(docs: DataFrame, shards: int, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, rank, fraction, shard and slot (gapless from 0 in each shard) of every row."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))  # null sources apart from any name
    rows = written(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            key.alias("stratum"),
            (F.octet_length(t).cast("long") + 8).alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), t).alias("hashed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("row")]
    ranked = fractional_ranks(rows, F.col("stratum"), [F.col("hashed"), *ties])
    placed = positions(ranked, [F.col("fraction"), F.col("stratum"), F.col("hashed"), *ties])
    shard = F.expr(f"position * {shards} div total")
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return out.select("doc_id", "source", "size", "text_crc32", "rank", "fraction", F.col("shard").cast("int").alias("shard"), "slot")


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interleave(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"
    )


QUERIES = {"op6_interleaved_shards": op6_interleaved_shards}
