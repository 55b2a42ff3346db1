"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every test item gives its word 3-grams as seeds (its only n-gram, if it has fewer words). One pass over the corpus counts how often each seed occurs
there. A second pass finds the documents that hold rare seeds; the places of their n-grams join the seeds by hash. Places of an item that
lie close together are one passage, which is cut from the document's word hashes and aligned with the item: match 1, mismatch and gap -1. It is
reported from a score of L - 2 e on, for an item of L words of which e (a fifth at most, see allowed_edits) may be edited.

An alignment of that score has a changed or lost words, b words put in and c words cut off at the ends, with 2 a + b + c <= 2 e. They spoil at most
3 a + 2 b + c <= 4 e seeds, so the 4 e + 1 rarest ones meet every such passage: the most frequent seeds are left out without a loss.

Tasks drop n-grams that are no seed by a bitmap of a fixed size, whatever the number of seeds; what it lets through by chance
is dropped by the join. There is one way for all sizes of the benchmark.

Defined cases: null or blank documents hold nothing; null or blank test items are not searched for; items of up to 6 words are found
where they are copied word by word; repeated documents and items are reported each by itself; of copies of an item that overlap in a document
the best one is reported, all others by themselves; very long documents and items take memory in proportion to their words; empty tables give an empty
result; further columns do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.bitmaps import bitmap, passing
from graticula.llm.common import fresh, words, written
from graticula.llm.ngrams import hashed, inside, ngram_hashes
from graticula.llm.tokens import runs, slices

SEED = 3
BATCH_BYTES = 1_000_000


def allowed_edits(length: int) -> int:
    """A fifth of the words, but so few that 4 e + 1 seeds are left: none up to 6 words."""
    return min(length // 5, max(0, length - 3) // 4)


def _edits(length: Column) -> Column:
    return F.least(F.floor(length / 5), F.floor(F.greatest(F.lit(0), length - 3) / 4))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-hash arrays: score, and where it begins and ends in the passage."""
    m = len(passage)
    at = np.arange(1, m + 1)
    prev, began = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = prev[:-1] + np.where(passage == w, 1, -1)
        up = prev[1:] - 1
        here = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(here == 0, at, np.where(diagonal >= up, began[:-1], began[1:]))
        # gaps along the passage: the running maximum of (value + position), less the position
        reach = np.maximum.accumulate(here + at)
        source = np.maximum.accumulate(np.where(here + at == reach, np.arange(m), -1))
        value = reach - at
        start = np.where(value > here, start[source], start)
        prev, began = np.concatenate(([0], value)), np.concatenate(([0], np.where(value > 0, start, at)))
        if m and value.max() > best[0]:
            # of equal ones one in the middle, so that what is left of a passage of many copies falls into halves
            at_best = np.flatnonzero(value == value.max())
            j = int(at_best[len(at_best) // 2])
            best = (int(value[j]), int(began[j + 1]), j + 1)
    return best


def all_places(item: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Disjoint alignments that score `least` or more, in order: the best one, then those in what is left before and behind it."""
    out, open_ = [], [(0, len(passage))]
    while open_:
        a, b = open_.pop()
        # an alignment of that score has as many equal words
        if b - a < least:
            continue
        score, began, ended = align(item, passage[a:b])
        if score >= least:
            out.append((score, a + began, a + ended))
            open_ += [(a, a + began), (a + ended, b)]
    return sorted(out, key=lambda x: x[1])


def _of_order(grams: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams of different lengths are kept apart."""
    return grams ^ np.uint64(order * 0x9E3779B97F4A7C15 & (2**64 - 1))


def _seeds(texts: pa.StringArray, orders: list[int], own: bool = False) -> tuple[np.ndarray, ...]:
    """Of all n-grams of the given orders: text, first word and hash; also the words' hashes and the texts' word counts.

    own: of each text only the n-grams of its own order, SEED or all its words.
    """
    hashes, counts = hashed(texts)
    starts = np.cumsum(counts) - counts
    doc, pos, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in orders:
        at = np.flatnonzero(inside(counts, n))
        text = np.searchsorted(starts, at, "right") - 1
        grams = _of_order(ngram_hashes(hashes, n)[at], n)
        if own:
            mine = np.minimum(counts[text], SEED) == n
            at, text, grams = at[mine], text[mine], grams[mine]
        doc.append(text), pos.append(at - starts[text]), seed.append(grams)
    return *(np.concatenate(x) for x in (doc, pos, seed)), hashes, counts


def item_seeds(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words, item_words: the words' hashes) and their seeds (item, at, seed)."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    t = F.col(f"`{text}`")
    numbered = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), t.alias("t")).filter(F.size(words(t)) > 0)
    numbered = written(numbered.select(F.monotonically_increasing_id().alias("item"), "item_id", "t"), "benchmark-items")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), BATCH_BYTES):
                hashes, counts = hashed(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in (0, 1)), pa.array(counts), runs(hashes, counts)], ["item", "item_id", "words", "item_words"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), BATCH_BYTES):
                doc, pos, seed, _, _ = _seeds(texts, [1, 2, 3], own=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + doc)), pa.array(pos), pa.array(seed.view(np.int64))], ["item", "at", "seed"])

    return numbered.mapInArrow(items, f"item long, item_id {kind}, words long, item_words binary"), numbered.mapInArrow(seeds, "item long, at long, seed long")


def seed_counts(docs: DataFrame, seeds: DataFrame, orders: list[int]) -> DataFrame:
    """seed, n: how often each distinct seed occurs in all documents (those that never occur are left out)."""
    known = seeds.select("seed").distinct()
    flags = bitmap(known, "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0), BATCH_BYTES):
                grams = _seeds(texts, orders)[2]
                found, n = np.unique(grams[passing(flags, grams)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["seed", "n"])

    found = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return found.join(known, "seed", "left_semi")


def suspects(docs: DataFrame, seeds: DataFrame, orders: list[int]) -> DataFrame:
    """row, doc_id, text_hash, the words' hashes, and places and hashes of the n-grams that may be seeds, of every document that has some."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    flags = bitmap(seeds, "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), BATCH_BYTES):
                doc, pos, seed, hashes, counts = _seeds(texts, orders)
                hit = passing(flags, seed)
                hit = hit[np.argsort(doc[hit], kind="stable")]
                rows, n = np.unique(doc[hit], return_counts=True)
                if not len(rows):
                    continue
                own = np.repeat(np.isin(np.arange(len(counts)), rows), counts)
                lists = lambda x, n=n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x))
                take = pa.array(at + rows)
                columns = [batch.column(0).take(take), batch.column(2).take(take), runs(hashes[own], counts[rows]), lists(pos[hit]), lists(seed[hit].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "hashes", "at", "seeds"])

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, hashes binary, at array<long>, seeds array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "suspects")


def spans(hits: DataFrame) -> DataFrame:
    """row, item, lo, hi: the surroundings of hits (row, item, at, pos, words, length) of an item in a document, joined while they touch."""
    begin, slack = F.col("pos") - F.col("at"), 2 * _edits(F.col("words"))
    wide = hits.select("row", "item", F.greatest(F.lit(0), begin - slack).alias("lo"), F.least("length", begin + F.col("words") + slack).alias("hi")).distinct()
    before = Window.partitionBy("row", "item").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "item").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("long"))
    return wide.withColumn("run", F.sum("new").over(upto)).groupBy("row", "item", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of docs (doc_id, text) that copy test items: doc_id, text_hash, item_id, words, score, similarity, start_word, end_word."""
    items, seeds = item_seeds(benchmark)
    items, seeds = written(items, "benchmark-words"), written(seeds, "benchmark-seeds")
    # at most three orders
    orders = sorted(r[0] for r in items.select(F.least("words", F.lit(SEED))).distinct().collect())
    counted = seeds.join(seed_counts(docs, seeds, orders), "seed", "left").join(items.select("item", "words"), "item")
    rarest = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "at")
    rare = counted.withColumn("k", F.row_number().over(rarest)).filter(F.col("k") <= 4 * _edits(F.col("words")) + 1)
    rare = written(rare.select("item", "at", "seed", "words"), "rare-seeds")

    rows = suspects(docs, rare, orders)
    length = F.octet_length("hashes") / 8
    places = rows.select("row", length.cast("long").alias("length"), F.inline(F.arrays_zip("at", "seeds")).alias("pos", "seed"))
    hits = places.join(rare, "seed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_kind = benchmark.schema["item_id"].dataType.simpleString()
    # a document's passages, cut before the items come in
    cut = spans(hits).join(rows.select("row", "doc_id", "text_hash", "hashes"), "row")
    passage = F.expr("substring(hashes, int(8 * lo + 1), int(8 * (hi - lo)))")
    cut = cut.select("doc_id", "text_hash", "item", "lo", passage.alias("passage"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
            places = []
            for item, passage in zip(pdf["item_words"], pdf["passage"], strict=True):
                if (item, passage) not in known:
                    words_ = len(item) // 8
                    known[item, passage] = all_places(np.frombuffer(item, np.uint64), np.frombuffer(passage, np.uint64), words_ - 2 * allowed_edits(words_))
                places.append(known[item, passage])
            score, began, ended = np.array([x for p in places for x in p], np.int64).reshape(-1, 3).T
            out = pdf[["doc_id", "text_hash", "item_id", "words", "lo"]].iloc[np.repeat(np.arange(len(pdf)), [len(p) for p in places])]
            out = out.assign(score=score, similarity=score / out["words"], start_word=out["lo"] + began, end_word=out["lo"] + ended)
            yield out.drop(columns="lo")

    return cut.join(items, "item").select("doc_id", "text_hash", "item_id", "words", "item_words", "lo", "passage").mapInPandas(
        run, f"doc_id {kind}, text_hash long, item_id {id_kind}, words long, score long, similarity double, start_word long, end_word long"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item. Null and empty texts hold none and stay; repeated rows go or stay together, with every further column."""
    found = contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    bad_id, bad_hash = fresh(docs, "bad_id", "bad_hash")
    bad = written(found.select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(docs["text"]) == bad[bad_hash])
    return docs.join(bad, same, "left_anti")


def op5_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark).drop("text_hash").withColumn("similarity", F.round("similarity", 6))


QUERIES = {"op5_seeded_alignment": op5_seeded_alignment}
