"""Packing along a space-filling curve.

Each document is a hashed bag of its token ids, projected to three dimensions by fixed random signs; its Hilbert key orders the
documents, so neighbours on the curve have similar vectors. The documents are range-sorted by that key and laid end to end, and the
line is cut every `length` tokens: all sequences but the last are full.

The ids are computed once and written; only rows of (key, id, count) are range-sorted. A document's offset on the line is the sum
before its range partition plus the sum before it in that partition, and its pieces follow from the offset alone.

Defined cases: a null text counts as empty and yields its end token only; documents without tokens have the zero vector; ties of the key
are ordered by id, then by row; repeated rows are packed each by itself; an empty table gives an empty result; further columns
do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.common import shuffle_partitions, written
from graticula.llm.tokens import flat, runs, slices, tokenizer

HASHED = 64
DIMENSIONS = 3
ORDER = 10  # bits of each dimension


def projection(vocabulary: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id its hashed dimension and sign, and the signs that project the hashed dimensions."""
    ids = np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed << 32)
    with np.errstate(over="ignore"):
        z = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bucket = (z % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(z >> np.uint64(63), 1.0, -1.0)
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (HASHED, DIMENSIONS))
    return bucket, sign, signs


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert indices of integer cells (n, d) with `order` bits a dimension: inverse undo of the transposed axes, then Gray code."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (order - 1)
    while q > 1:
        t = np.where(x[:, d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(order - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def hilbert_keys(ids: np.ndarray, counts: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The key of each document on the curve: counts[i] of the ids, one document after the other."""
    bucket, sign, signs = tables
    doc = np.repeat(np.arange(len(counts)) * HASHED, counts)
    v = np.bincount(doc + bucket[ids], sign[ids], len(counts) * HASHED).reshape(-1, HASHED)
    norm = np.sqrt((v * v).sum(1))
    # whole numbers, so the products are exact whatever the size of the batch
    y = (v @ signs) / np.where(norm > 0, norm, 1)[:, None]
    return hilbert_key(np.clip(((np.tanh(y) + 1) / 2 * (1 << ORDER)).astype(np.int64), 0, (1 << ORDER) - 1))


def tokenized(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (with the end token), ids (binary, 2 or 4 bytes each) and the Hilbert key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        tables = projection(tok.size)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = tok.ids(texts, end_id)
                values, n = flat(ids, tok.dtype)
                own = np.ones(len(values), bool)  # but for the end tokens
                own[np.cumsum(n) - 1] = False
                key = hilbert_keys(values[own], n - 1, tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), ids, pa.array(key)], ["doc_id", "n", "ids", "key"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"doc_id {kind}, n long, ids binary, key long")


def running_offsets(rows: DataFrame, order: list[str], count: str) -> DataFrame:
    """rows (small ones) with part and before: range-sorted by order, before is the sum of count in the same part so far."""
    parts = shuffle_partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for pdf in batches:
            n = pdf[count].to_numpy()
            ends = total + np.cumsum(n)
            yield pdf.assign(before=ends - n)
            total = int(ends[-1]) if len(ends) else total

    return ranged.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", before long")


def offsets(rows: DataFrame, order: list[str], count: str) -> DataFrame:
    """rows with start: the sum of count over all rows before them in the given order."""
    local = written(running_offsets(rows, order, count), "offsets")
    sums = local.groupBy("part").agg(F.sum(count).alias("__sum"))  # a row for each partition
    sums = sums.select("part", (F.sum("__sum").over(Window.orderBy("part")) - F.col("__sum")).alias("__base"))
    return local.join(sums, "part").withColumn("start", F.col("before") + F.col("__base")).drop("before", "__base", "part")


def pack(docs: DataFrame, path: str, end_id: int, length: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian)."""
    if length < 1:
        raise ValueError("length must be positive")
    dtype = tokenizer(path).dtype
    rows = written(tokenized(docs, path, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "packed-ids")
    placed = offsets(rows.select("key", "doc_id", "row", "n"), ["key", "doc_id", "row"], "n")
    whole = rows.select("row", "ids").join(placed.select("row", "doc_id", "n", "start", "key"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, key = (batch.column(c).to_numpy() for c in (2, 1, 4))
            pieces = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = at[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, end = np.maximum(at[doc], sequence * length), np.minimum((at + n)[doc], (sequence + 1) * length)
            values = flat(batch.column(3), dtype)[0].astype("<u4")
            out = [begin - at[doc], end - begin, n[doc], sequence, begin - sequence * length]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *(pa.array(x) for x in out), runs(values, end - begin), pa.array(key[doc])],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "hilbert"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return whole.select("doc_id", "n", "start", "ids", "key").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, hilbert long"
    )


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "hilbert")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of docs, as op3 gives them: null and empty texts, repeated rows, ties and empty tables as stated above."""
    return digested(pack(docs, vocabulary(), 1))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), 1))


QUERIES = {"op3_hilbert_packing": op3_hilbert_packing}
