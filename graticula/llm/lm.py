"""Stupid-backoff scores.

The texts' n-grams are exploded batch by batch, each batch's distinct ones once, and dealt by ranges of their hash. A range gathers its part of the
count table and joins the batches' n-grams to it; the counts go back to their batches, where they are summed for each document. A frequent
n-gram is one entry of a batch, however many documents hold it, so no range grows with it. N-grams travel as sorted arrays, one row for
each batch and range that has any (so never more rows than n-grams): as a row each they take 7 times the input on disk.

S(w | h) = count(h w) / count(h) if the n-gram h w was seen, else alpha * S(w | shorter h); for single words count(w) / words. The score of
a document is the sum of log S over its words, each with as much history as the document has before it, up to order - 1 words.
Counts are those of other texts: of the training texts, if there are any, else of all documents but the one that is scored (a document is
a row: a copy of it counts). Words that were never seen have the share of half an occurrence.

Words are split at space and U+0009 to U+000D, with A-Z lower-cased.

Defined cases: a null or blank text has no words and score 0; repeated rows are documents of their own; with empty training texts, or a
single document, every word is unseen; a very long text is one row of its batch and takes memory in proportion to its words; an empty
table gives an empty result; further columns do not take part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.common import shuffle_partitions
from graticula.llm.ngrams import hashed, inside, ngram_hashes

BATCH_BYTES = 6_000_000
#: Stands where no n-gram ends.
NOTHING = np.uint64(0)


def _grams(texts: pa.StringArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n from 1 to order the hashes of the n-grams that end at each word (0 where there is none), and words by text."""
    words, counts = hashed(texts)
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            h[n - 1 :] = np.where(inside(counts, n), _of_order(ngram_hashes(words, n), n), NOTHING)
        out.append(h)
    return out, counts


def _of_order(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of different orders are kept apart; none is 0."""
    return (h ^ np.uint64(0x9E3779B97F4A7C15 * n & (2**64 - 1))) | np.uint64(1)


def _texts(column: pa.ChunkedArray) -> pa.StringArray:
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    return texts.fill_null("").cast(pa.string())


def dealt(df: DataFrame, doc_id: str | None, text: str) -> tuple[DataFrame, int]:
    """doc_id, t and batch: rows in batches of about BATCH_BYTES, whatever their texts and ids; and the bytes of all texts."""
    t = F.col(f"`{text}`")
    size = df.agg(F.sum(F.octet_length(t))).first()[0] or 0
    number = F.xxhash64(F.monotonically_increasing_id())  # of a scan: the same each time
    batch = F.pmod(number, F.lit(max(1, size // BATCH_BYTES))).cast("int")
    return df.select((F.col(f"`{doc_id}`") if doc_id else F.lit(0)).alias("doc_id"), t.alias("t"), batch.alias("batch")), size


def _ranges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted hashes each of the equal hash ranges begins, and the end."""
    limits = np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(h, limits), [len(h)]))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all the lowest bytes first, so that leading zeros compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def exploded(batches: DataFrame, order: int, buckets: int, train: bool = True, asks: bool = True) -> DataFrame:
    """bucket, batch, words, grams, times: for each batch and hash range the distinct n-grams.

    words: of the whole batch, in its first range; times: how often each occurs, if it is trained on; batch: null unless it asks.
    """

    def run(table: pa.Table) -> pa.Table:
        grams, counts = _grams(_texts(table.column("t")), order)
        found, n = np.unique(np.concatenate(grams), return_counts=True)
        if len(found) and found[0] == NOTHING:
            found, n = found[1:], n[1:]
        edge = _ranges(found, buckets)
        some = [b for b in range(buckets) if not b or edge[b] < edge[b + 1]]
        parts = [slice(edge[b], edge[b + 1]) for b in some]
        return pa.table({
            "bucket": pa.array(some, pa.int32()),
            "batch": pa.array([table.column("batch")[0].as_py() if asks else None] * len(some), pa.int32()),
            "words": pa.array([int(counts.sum()) if train and not b else 0 for b in some], pa.int64()),
            "grams": pa.array([_planes(np.diff(found[p], prepend=NOTHING)) for p in parts], pa.binary()),
            "times": pa.array([_planes(n[p]) if train else None for p in parts], pa.binary()),
        })

    return batches.groupBy("batch").applyInArrow(run, "bucket int, batch int, words long, grams binary, times binary")


def joined(table: pa.Table) -> pa.Table:
    """The n-grams of a hash range, joined to their count table: bucket, batch, words, counts in the order of each batch's n-grams."""
    grams = [np.cumsum(_from_planes(g), dtype=np.uint64) for g in table.column("grams").to_pylist()]
    times = [None if t is None else _from_planes(t).astype(np.int64) for t in table.column("times").to_pylist()]
    flat = np.concatenate([g for g, t in zip(grams, times, strict=True) if t is not None] or [np.zeros(0, np.uint64)])
    known, where = np.unique(flat, return_inverse=True)
    count = np.bincount(where, np.concatenate([t for t in times if t is not None] or [np.zeros(0)]), len(known)).astype(np.int64)
    words = sum(table.column("words").to_pylist())
    out = []
    for g, batch in zip(grams, table.column("batch").to_pylist(), strict=True):
        if batch is not None:
            at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
            out.append((batch, _planes(np.where(known[at] == g, count[at], 0) if len(known) else np.zeros(len(g), np.int64))))
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()),
        "batch": pa.array([b for b, _ in out], pa.int32()),
        "words": pa.array([words] * len(out), pa.int64()),
        "counts": pa.array([c for _, c in out], pa.binary()),
    })


def summed(texts: pa.StringArray, order: int, alpha: float, counts: np.ndarray, total: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """words and score of each text; counts: those of the distinct n-grams of all texts, by their hashes; total: the number of words.

    leave_out: less each text's own n-grams and words.
    """
    grams, words = _grams(texts, order)
    distinct, back = np.unique(np.concatenate(grams), return_inverse=True)
    if len(distinct) and distinct[0] == NOTHING:
        counts = np.concatenate(([0], counts))
    c = counts[back].reshape(order, -1) if len(distinct) else np.zeros((order, 0), np.int64)
    totals = np.full(len(words), total)
    if leave_out:
        text = np.tile(np.repeat(np.arange(len(words)), words), order)
        _, own, n = np.unique(text * len(distinct) + back.reshape(-1), return_inverse=True, return_counts=True)
        c = c - n[own].reshape(order, -1)
        totals = totals - words
    totals = np.repeat(np.maximum(totals, 1), words)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.log(np.maximum(c[0], 0.5) / totals)
        for k in range(1, order):
            history = np.concatenate(([0], c[k - 1][:-1])) if c.shape[1] else c[k - 1]
            score = np.where(grams[k] != NOTHING, np.where(c[k] > 0, np.log(c[k] / history), score + np.log(alpha)), score)
    ends = np.cumsum(words)
    return words, np.array([score[e - k : e].sum() for e, k in zip(ends.tolist(), words.tolist(), strict=True)])


def backoff_scores(docs: DataFrame, train: DataFrame | None = None, order: int = 2, alpha: float = 0.4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, words and score of every row of docs, by counts over train; if it is None, over all other rows of docs."""
    if order < 1:
        raise ValueError("order must be at least 1")
    leave_out = train is None
    mine, size = dealt(docs, doc_id, text)
    if leave_out:
        buckets = _buckets(docs, size)
        asked = exploded(mine, order, buckets)
    else:
        other, more = dealt(train, None, text)
        buckets = _buckets(docs, size + more)
        asked = exploded(other, order, buckets, asks=False).union(exploded(mine, order, buckets, train=False))
    replies = asked.groupBy("bucket").applyInArrow(joined, "bucket int, batch int, words long, counts binary")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("bucket")
        counts = np.concatenate([_from_planes(c) for c in got.column("counts").to_pylist()] or [np.zeros(0)]).astype(np.int64)
        words, score = summed(_texts(table.column("t")), order, alpha, counts, max(got.column("words").to_pylist(), default=0), leave_out)
        return pa.table({"doc_id": table.column("doc_id"), "words": pa.array(words, pa.int64()), "score": pa.array(score, pa.float64())})

    return mine.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, f"doc_id {kind}, words long, score double")


def _buckets(docs: DataFrame, size: int) -> int:
    return max(shuffle_partitions(docs.sparkSession), size // (2 * BATCH_BYTES))


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the counts of all others, with words and pairs of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return backoff_scores(docs).withColumn("score", F.round("score", 4))


QUERIES = {"op1_stupid_backoff": op1_stupid_backoff}
ORACLES = {
    "op1_stupid_backoff": """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), t AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
p AS (SELECT r, i, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS prev FROM t),
o1 AS (SELECT r, word, count(*) AS own FROM t GROUP BY r, word),
c1 AS (SELECT word, sum(own) AS n FROM o1 GROUP BY word),
o2 AS (SELECT r, prev, word, count(*) AS own FROM p WHERE prev IS NOT NULL GROUP BY r, prev, word),
c2 AS (SELECT prev, word, sum(own) AS n FROM o2 GROUP BY prev, word),
l1 AS (SELECT o1.r, o1.word, c1.n - o1.own AS n FROM o1 JOIN c1 ON c1.word = o1.word),
l2 AS (SELECT o2.r, o2.prev, o2.word, c2.n - o2.own AS n FROM o2 JOIN c2 ON c2.prev = o2.prev AND c2.word = o2.word),
scored AS (
  SELECT p.r, CASE WHEN l2.n > 0 THEN ln(l2.n / h.n)
    ELSE ln(greatest(u.n, 0.5) / greatest((SELECT count(*) FROM t) - len(w.ws), 1)) + CASE WHEN p.prev IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM p JOIN w ON w.r = p.r JOIN l1 u ON u.r = p.r AND u.word = p.word
  LEFT JOIN l1 h ON h.r = p.r AND h.word = p.prev LEFT JOIN l2 ON l2.r = p.r AND l2.prev = p.prev AND l2.word = p.word
)
SELECT w.doc_id, len(w.ws)::BIGINT AS words, round(coalesce(x.s, 0.0), 4)::DOUBLE AS score FROM w LEFT JOIN (SELECT r, sum(s) AS s FROM scored GROUP BY r) x ON x.r = w.r
"""
}
