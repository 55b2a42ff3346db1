"""Token-id output by a static range asymmetric numeral system.

The files are two Parquet tables in one folder. `table` holds one row: the symbol frequencies that all blocks share, counted over the whole corpus,
with their checksum. `blocks` holds the blocks: each a run of whole documents in ascending id order. A block's symbols are dealt to interleaved
coder lanes, row by row, so all lanes step together on arrays. Every STRIDE rows of symbols there is a checkpoint: the states of the lanes and
the number of code words before it. Decoding starts at all checkpoints of a block at once, so its arrays are as wide as all lanes of all
stretches, and each stretch must end in the state in which the next one begins. A block is a string of bytes: magic, sizes, checksum of its
ids, checksum of its bytes, number of ids before it in its partition, documents' ids and counts, checkpoints, code words.

Defined cases: a null text counts as empty and has its end token only; null ids come first; repeated ids are ordered by row;
an empty table gives no block and an empty result; further columns do not take part; a document longer than a block has a block of its own
or ends one; ids that are no integers are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graticula.llm.common import shared_dir, shuffle_partitions, written
from graticula.llm.tokens import flat, runs, slices, tokenizer

MAGIC = b"GRAN0002"
SCALE = 20  # frequencies add up to 2 ** SCALE
LOW = np.uint64(1 << 31)
BLOCK = 1 << 20  # symbols from which a block is closed
LANES = 2048
STRIDE = 128  # rows of symbols between checkpoints
HEAD = "<8sIIIIII"
HEAD_SIZE = struct.calcsize(HEAD)
#: Stands for a null id in a block.
NULL = -(1 << 63)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2 ** SCALE, at least 1 for every symbol that may occur."""
    total = int(counts.sum())
    size = 1 << SCALE
    if len(counts) > size // 2:
        raise ValueError("too many symbols")
    spare = size - len(counts)
    freq = 1 + (counts.astype(object) * spare // max(total, 1)).astype(np.int64)
    freq[int(np.argmax(counts))] += size - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq)), freq)

    def encode(self, ids: np.ndarray, docs: np.ndarray, counts: np.ndarray, before: int = 0) -> bytes:
        n, lanes = len(ids), max(1, min(LANES, len(ids)))
        rows = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words, marks, done = [], [], 0
        for r in range(rows - 1, -1, -1):
            s = ids[r * lanes : min(n, (r + 1) * lanes)]
            k = len(s)
            f, y = self.freq.take(s), x[:k]
            over = np.flatnonzero(y >= (f << np.uint64(63 - SCALE)))
            if len(over):
                out = y.take(over)
                words.append(out.astype("<u4")[::-1])
                done += len(over)
                y[over] = out >> np.uint64(32)
            q = y // f
            y -= q * f
            y += (q << np.uint64(SCALE)) + self.start.take(s)
            if r % STRIDE == 0:
                marks.append((done, x.copy()))
        code = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
        # a checkpoint for every STRIDE rows, the first one at the beginning: code words before it, and the lanes' states there
        points = b"".join(struct.pack("<I", done - behind) + state.astype("<u8").tobytes() for behind, state in reversed(marks))
        body = struct.pack("<Q", before) + docs.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + points + code.tobytes()
        head = struct.pack(HEAD, MAGIC, n, len(docs), lanes, len(marks), done, zlib.crc32(ids.astype("<u4").tobytes()))
        return head + struct.pack("<I", zlib.crc32(head + body)) + body

    def decode(self, block: bytes, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """ids from checkpoint `first` on, the documents' ids and counts, and the number of ids before the block."""
        magic, n, docs, lanes, marks, total, check = struct.unpack_from(HEAD, block)
        at = HEAD_SIZE + 4
        if magic != MAGIC or zlib.crc32(memoryview(block)[at:], zlib.crc32(block[:HEAD_SIZE])) != struct.unpack_from("<I", block, HEAD_SIZE)[0]:
            raise ValueError("damaged block")
        (before,) = struct.unpack_from("<Q", block, at)
        doc_ids = np.frombuffer(block, "<i8", docs, at + 8)
        counts = np.frombuffer(block, "<u4", docs, at + 8 + 8 * docs)
        at += 8 + 12 * docs
        points = np.frombuffer(block, np.dtype([("used", "<u4"), ("state", "<u8", (lanes,))]), marks, at)
        code = np.frombuffer(block, "<u4", total, at + points.nbytes)
        out = self._stretches(points[first:], code, n - first * STRIDE * lanes, lanes)
        if not first and zlib.crc32(out.astype("<u4").tobytes()) != check:
            raise ValueError("ids do not match their checksum")
        return out, doc_ids, counts, before

    def _stretches(self, points: np.ndarray, code: np.ndarray, n: int, lanes: int) -> np.ndarray:
        """n symbols: the stretches between checkpoints step together, each with its own place in the code words."""
        if not len(points):
            return np.zeros(0, np.uint32)
        stretches, mask = len(points), np.uint64((1 << SCALE) - 1)
        x, at = points["state"].astype(np.uint64), points["used"].astype(np.int64)
        out, code = np.zeros((stretches, STRIDE, lanes), np.uint32), code.astype(np.uint64)
        last = n - (stretches - 1) * STRIDE * lanes  # symbols of the last stretch
        for t in range(STRIDE):
            left = min(lanes, max(0, last - t * lanes))
            if stretches == 1 and not left:
                break
            low = x & mask
            s = self.slot.take(low.view(np.int64))
            out[:, t] = s
            new = x >> np.uint64(SCALE)
            new *= self.freq.take(s)
            new += low
            new -= self.start.take(s)
            if left < lanes:
                new[-1, left:] = x[-1, left:]
            under = new < LOW
            # each stretch takes its next code words, lane by lane
            lane = np.flatnonzero(under)
            used = np.count_nonzero(under, axis=1)
            where = np.repeat(at - np.cumsum(used) + used, used) + np.arange(len(lane))
            held = new.reshape(-1)
            held[lane] = (held.take(lane) << np.uint64(32)) | code.take(where)
            x, at = new, at + used
        if (at[:-1] != points["used"][1:]).any() or at[-1] != len(code) or (x[:-1] != points["state"][1:]).any() or (x[-1] != LOW).any():
            raise ValueError("a stretch does not end where the next one begins")
        return out.reshape(-1)[:n]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary, 2 or 4 bytes each, with the end token) of every row."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), tok.ids(texts, end_id)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def symbol_counts(rows: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each symbol occurs in all rows: a row for each symbol reaches the driver, as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0), dtype)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["symbol", "n"])

    found = rows.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["symbol"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def encode(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Writes the files of docs (doc_id, text) into folder, which must not exist."""
    spark, tok = docs.sparkSession, tokenizer(path)
    size, dtype = tok.size, tok.dtype
    rows = written(tokenized(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    freq = normalised(symbol_counts(rows, size, dtype))
    raw = freq.astype("<u4").tobytes()
    spark.createDataFrame([(SCALE, size, raw, zlib.crc32(raw))], "scale int, symbols long, frequencies binary, crc32 long").coalesce(1).write.parquet(f"{folder}/table")
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = Coder(freq), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # documents' ids, counts, symbols
        amount = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            docs_, (values, n) = batch.column(1).fill_null(NULL).to_numpy(), flat(batch.column(2), dtype)
            ends = np.cumsum(n)
            row = 0
            while row < len(n):
                begun = ends[row] - n[row]
                to = min(len(n), int(np.searchsorted(ends, begun + BLOCK - amount)) + 1)  # up to the document that fills the block
                held.append((docs_[row:to], n[row:to], values[begun : ends[to - 1]]))
                amount += int(ends[to - 1] - begun)
                row = to
                if amount >= BLOCK:
                    yield block(coder, part, before, held)
                    held, amount, before = [], 0, before + amount
        if held:
            yield block(coder, part, before, held)

    def block(coder: Coder, part: int, before: int, held: list) -> pa.RecordBatch:
        docs_, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        payload = coder.encode(ids.astype(np.uint32), docs_, counts, before)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)]), pa.array([payload], pa.binary())], ["part", "n", "payload"])

    blocks = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(run, "part int, n long, payload binary")
    blocks.write.parquet(f"{folder}/blocks")


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, from the files alone."""
    table = spark.read.parquet(f"{folder}/table").first()  # one row, as long as the vocabulary
    if table.scale != SCALE or zlib.crc32(table.frequencies) != table.crc32:
        raise ValueError("damaged frequency table")
    freq = np.frombuffer(table.frequencies, "<u4").astype(np.int64)
    blocks = spark.read.schema("part int, n long, payload binary").parquet(f"{folder}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("n").alias("__n"))  # a row for each partition that was written
    sums = sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for base, payload in zip(batch.column(0), batch.column(1), strict=True):
                ids, docs, counts, before = coder.decode(payload.as_buffer().to_pybytes())
                n = counts.astype(np.int64)
                out = [pa.array(docs, mask=docs == NULL), pa.array(base.as_py() + before + np.cumsum(n) - n), pa.array(n), runs(ids.astype("<u4"), n)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(sums), "part")
    return placed.select("base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), 0, folder)
    return decode(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_rans_blocks": op9_rans_blocks}
