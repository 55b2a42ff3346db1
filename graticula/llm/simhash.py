"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is 1 if it is set in over half of the hashes of a document's shingles. Fingerprints that differ in at most `budget`
bits are linked, and linked documents form components.

The self-join walks pairs of nodes of the binary trie of all distinct fingerprints together: a pair splits into its pairs of
children, adds the bit in which they differ, and is dropped once it exceeds the budget. To start the walk from many small subtries in
place of one root, the 64 bits are cut into budget + 1 blocks: two fingerprints within the budget agree on one block at least, so
each pair meets in the trie in which that block comes first, below a node that both share. Each block's trie is dealt out by its
leading block, split once more in the same way over the remaining bits, so a node with very many fingerprints is spread over many
groups; what a group shares is exact, and no pair within the budget is missed. A group gives links from each fingerprint to the
smallest one that it is joined with, never all pairs. Copies have equal fingerprints and enter the trie once.

Components come from label propagation with pointer jumping over the links, each round written to the shared folder.

Defined cases: a null or blank text has fingerprint zero, which is linked like any other; fewer words than a shingle holds give
one shingle of all words; repeated rows are copies of each other; a null id is never a component's id unless all ids of the component
are null; an empty table gives an empty result; further columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.bitmaps import bitmap, passing
from graticula.llm.common import fresh, shuffle_partitions, written
from graticula.llm.ngrams import hashed, inside, ngram_hashes
from graticula.llm.tokens import flat, runs, slices

BITS = 64
#: Node pairs that one step of the walk holds at once; more are walked in turn.
FRONTIER = 1 << 20
#: A fingerprint of more than one row in so many is joined apart.
HOT = 2000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text: A-Z lower-cased, words split at space and U+0009 to U+000D."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["t"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(run, f"doc_id {kind}, fp long")


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    edges = [width * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def plans(budget: int, levels: int = 2) -> list[list[int]]:
    """Bit orders of the tries: for each choice of a block, and of a block among the rest, the leading bits that a group shares."""
    orders = [([], list(range(BITS)))]
    for _ in range(levels):
        orders = [(head + rest[a:b], rest[:a] + rest[b:]) for head, rest in orders for a, b in _cuts(len(rest), budget + 1)]
    return [head for head, _ in orders]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that it is connected with by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == root).all():
            return root
        root = new


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int, near=None) -> np.ndarray:
    """For each fingerprint the index of the smallest one of its group that it is linked with, directly or over others.

    group, fp: sorted by both. A node of the trie is a range of the sorted fingerprints; pairs of nodes are walked from the groups'
    roots down, one bit at a time. Distinct fingerprints of a group differ, so a leaf is one fingerprint. near: a further test of pairs.
    """
    n = len(fp)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    root = np.arange(n)
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    found_a, found_b = [], []
    held = 0
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for part in (slice(0, half), slice(half, None)):
                stack.append((bit, alo[part], ahi[part], blo[part], bhi[part], diff[part]))
            continue
        if bit < 0:
            other = alo != blo
            if near is not None:
                other[other] = near(alo[other], blo[other])
            found_a.append(alo[other])
            found_b.append(blo[other])
            held += int(other.sum())
            if held > FRONTIER:  # fold what is known, so that links held stay bounded
                root = _roots(n, np.concatenate([np.arange(n), *found_a]), np.concatenate([root, *found_b]))
                found_a, found_b, held = [], [], 0
            continue
        amid, bmid = _split(fp, bit, alo, ahi), _split(fp, bit, blo, bhi)
        same = (alo == blo) & (ahi == bhi)
        out = []
        for xlo, xhi, ylo, yhi, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (xlo < xhi) & (ylo < yhi) & (diff + more <= budget)
            if more and xlo is amid:
                keep &= ~same  # a node with itself: the two mixed pairs are one
            if not more:
                keep &= ~(same & (xhi - xlo == 1))  # one fingerprint with itself
            out.append((xlo[keep], xhi[keep], ylo[keep], yhi[keep], diff[keep] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    if found_a:
        root = _roots(n, np.concatenate([np.arange(n), *found_a]), np.concatenate([root, *found_b]))
    return root


def _split(fp: np.ndarray, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where in each range, sorted and equal above bit, the fingerprints with that bit set begin."""
    one = np.uint64(1) << np.uint64(bit)
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) // 2
        high = np.zeros(len(mid), bool)
        high[open_] = (fp[mid[open_]] & one) != 0
        b = np.where(open_ & high, mid, b)
        a = np.where(open_ & ~high, mid + 1, a)
    return a


def near_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """fp_a, fp_b: links between distinct fingerprints of fps (fp long) that connect all within the budget, and no others."""
    # a node is its leading bits as they lie in the fingerprint: one mask for each trie. Bit by bit, the plan took much of the driver's memory
    masks = [sum(1 << i for i in bits) for bits in plans(budget)]
    node = lambda mask: F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long"))
    keys = fps.select("fp", F.inline(F.array(*(F.struct(F.lit(t).alias("trie"), node(mask).alias("node")) for t, mask in enumerate(masks)))))
    sizes = keys.groupBy("trie", "node").count().filter("count > 1").select("trie", "node")
    keys = keys.join(sizes, ["trie", "node"], "left_semi")
    parts = shuffle_partitions(fps.sparkSession)
    keys = keys.repartition(parts, "trie", "node").sortWithinPartitions("trie", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(rest):
                continue
            last = (rest["trie"].to_numpy() == rest["trie"].iloc[-1]) & (rest["node"].to_numpy() == rest["node"].iloc[-1])
            yield from walk(rest[~last])
            rest = rest[last]
        if rest is not None:
            yield from walk(rest)

    def walk(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(pdf) < 2:
            return
        fp, trie, node = pdf["fp"].to_numpy().view(np.uint64), pdf["trie"].to_numpy(), pdf["node"].to_numpy()
        order = np.lexsort((fp, node, trie))
        fp, trie, node = fp[order], trie[order], node[order]
        group = np.concatenate(([0], np.cumsum((trie[1:] != trie[:-1]) | (node[1:] != node[:-1]))))
        root = trie_links(group, fp, budget)
        own = root != np.arange(len(fp))
        yield pd.DataFrame({"fp_a": fp[root[own]].view(np.int64), "fp_b": fp[own].view(np.int64)})

    return keys.mapInPandas(run, "fp_a long, fp_b long")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, label: for every node of links (a, b) the smallest node that it is connected with."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = written(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        # the label of a node's label moves with it, so whole trees hook at once
        moved = hooked.groupBy(F.col("label").alias("tree")).agg(F.min("low").alias("to"))
        stepped = hooked.join(moved, hooked["label"] == moved["tree"]).select("node", "label", F.least("low", "to").alias("low"))
        jump = stepped.select(F.col("node").alias("at"), F.col("low").alias("next"))
        new = stepped.join(jump, stepped["low"] == jump["at"]).select("node", F.least("low", "next").alias("label"), F.col("label").alias("was"))
        new = written(new, "labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row."""
    rows = written(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    heads = written(rows.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    links = near_links(heads.select("fp"), budget)
    labels = components(links.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    members = labels.join(heads, labels["node"] == heads["fp"]).select("fp", "label", "head")
    lowest = members.groupBy("label").agg(F.min("head").alias("component"))
    known = members.join(lowest, "label").select(F.col("fp").alias("fp2"), "component")
    of_fp = written(heads.join(known, heads["fp"] == known["fp2"], "left").select("fp", F.coalesce("component", "head").alias("component_id"), "n"), "components")
    total = of_fp.agg(F.sum("n")).first()[0] or 0
    # fingerprints of more than one row in HOT: less than HOT of them, so they go to all tasks; the others are joined by key
    hot = F.col("n") * HOT > total
    many, few = F.broadcast(of_fp.filter(hot).drop("n")), of_fp.filter(~hot).drop("n")
    out = rows.join(many, "fp").unionByName(rows.join(many.select("fp"), "fp", "left_anti").join(few, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash_trie": op8_simhash_trie}


# Similar texts: pairs whose shingle sets have a Jaccard similarity of at least a limit, found by prefixes and decided exactly.

#: One text of so many is asked for common shingles, and so many of those are told apart. They only steer the order of shingles, so how much
#: is compared, never what is found.
SAMPLED, COMMON = 16, 1 << 18
#: Groups with more texts are first compared with a few of their own, so that near copies are known to be linked before pairs are made.
LARGE, PIVOTS, CENTRAL = 8, 4, 2
BATCH_BYTES = 1_000_000


def _sets(texts: pa.StringArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """text and hash of the distinct shingles of each text, ascending: all words if they are fewer than a shingle holds, 0 without words."""
    words, counts = hashed(texts)
    starts = np.cumsum(counts) - counts
    at = np.flatnonzero(inside(counts, shingle))
    docs, grams = [np.searchsorted(starts, at, "right") - 1], [ngram_hashes(words, shingle)[at]]
    for n in range(shingle):
        few = np.flatnonzero(counts == n)
        docs.append(few)
        grams.append(ngram_hashes(words, n)[starts[few]] if n and len(few) else np.zeros(len(few), np.uint64))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    first = np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])))
    return doc[first], gram[first]


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with different ids: copies within a batch are read once."""
    ids = batch.column(0).to_numpy()
    return batch.take(pa.array(np.sort(np.unique(ids, return_index=True)[1])))


def _least(similarity: float, size):
    """The least number of shingles that a set of that size shares with a similar one."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in at least three sampled texts, ascending, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(_once(batch).column(1), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(texts, shingle)[1].view(np.int64))], ["token"])

    sample = docs.filter(F.pmod("id", F.lit(SAMPLED)) == 0).select("id", "text").mapInArrow(run, "token long")
    known = written(sample.groupBy("token").count().filter("count > 2"), "common-shingles")
    level = F.floor(F.log2("count"))
    least, total = 63, 0
    for at, n in sorted(known.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > COMMON:
            break
        least = at
    pdf = known.filter(level >= least).toPandas().sort_values("token")
    tokens = pdf["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], pdf["count"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """token, id, size, end: the first shingles of each text, rarest first, as many as make two similar texts share one of them.

    end: where the last of them is in the order of all shingles, rounded down.
    """
    common, times = _common(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            for at, texts in slices(batch.column(1), BATCH_BYTES):
                doc, gram = _sets(texts, shingle)
                gram = gram[np.lexsort((gram, times_of(gram), doc))]  # doc stays as it is
                size = np.bincount(doc, minlength=len(texts))
                place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                keep = place <= (size - _least(similarity, size))[doc]
                doc, gram = doc[keep], gram[keep]
                last = gram[np.cumsum(np.bincount(doc, minlength=len(texts))) - 1]
                end = (np.minimum(times_of(last), (1 << 20) - 1) << 43) | (last >> np.uint64(21)).astype(np.int64)
                columns = [gram.view(np.int64), batch.column(0).to_numpy()[at + doc], size[doc], end[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "id", "size", "end"])

    def times_of(gram: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(gram), np.int64)
        near = np.minimum(np.searchsorted(common, gram), len(common) - 1)
        return np.where(common[near] == gram, times[near], 0)

    return docs.select("id", "text").mapInArrow(run, "token long, id long, size long, end long")


def _may_be_similar(similarity: float) -> Column:
    """Pairs whose sizes, and first shingles that are among those of no other text, allow the similarity.

    What two sets share within the first shingles of the one whose first shingles end first is among those of the other, too: so that one shares
    at most its size less its `alone`.
    """
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    sizes = similarity * F.greatest("size_a", "size_b") <= F.least("size_a", "size_b") + 1e-9
    a, b = F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b")
    shared = F.when(F.col("end_a") < F.col("end_b"), a).when(F.col("end_a") > F.col("end_b"), b).otherwise(F.greatest(a, b))
    return sizes & (shared >= need)


def _enough(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, size_a, size_b, one row for each shared prefix shingle) that may be similar, each once.

    What two sets share is in both prefixes, or behind the end of the prefix that ends first: at most the shared prefix shingles and
    the rest of one set.
    """
    counted = pairs.groupBy("a", "b", "size_a", "size_b").count()
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    rest = F.ceil(F.lit(similarity) * F.greatest("size_a", "size_b") - 1e-9) - 1
    return counted.filter(F.col("count") + rest >= need).select("a", "b")


def _decided(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that similarity."""
    flags = bitmap(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            batch = batch.take(pa.array(passing(flags, batch.column(0).to_numpy().view(np.uint64))))
            for at, texts in slices(batch.column(1), BATCH_BYTES):
                doc, gram = _sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), runs(gram, np.bincount(doc, minlength=len(texts)))], ["key", "grams"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, n = flat(batch.column(2), np.dtype(np.uint64))
            y, m = flat(batch.column(3), np.dtype(np.uint64))
            for i, (s, e, t, f) in enumerate(zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), (np.cumsum(m) - m).tolist(), np.cumsum(m).tolist(), strict=True)):
                both = len(np.intersect1d(x[s:e], y[t:f], assume_unique=True))
                keep[i] = both >= similarity * (e - s + f - t - both) - 1e-9
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    sets = docs.select("id", "text").mapInArrow(run, "key long, grams binary")
    sets = written(sets.groupBy("key").agg(F.first("grams").alias("grams")), "shingle-sets")
    left, right = (sets.select(F.col("key").alias(f"key_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    joined = pairs.join(left, F.col("a") == F.col("key_a")).join(right, F.col("b") == F.col("key_b"))
    return joined.select("a", "b", "grams_a", "grams_b").mapInArrow(alike, "a long, b long")


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """a, b: links between ids of docs (id, text; equal ids have equal texts) that connect all whose sets of shingle hashes have at least
    that Jaccard similarity, and no others.

    Similar sets share a shingle among the first of each in one order of all shingles (prefix filter). Texts that share one are compared
    over their whole sets. In large groups all are compared with a few first, among them those with the fewest shingles of their own, which
    lie in the middle of near copies; what these links connect needs no pairs of its own, and all other pairs are made.
    """
    prefixes = written(_prefixes(docs, shingle, similarity), "prefixes")
    # most shingles are in one text: only their counts are dealt out. Copies that were read in different batches are one from here on.
    often = prefixes.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    shared = written(prefixes.join(often, "token").distinct(), "repeated-prefixes")
    groups = shared.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    # alone: how many of a text's first shingles are among those of no other
    shared = shared.join(groups, "token")
    alone = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1 - F.count("*").over(Window.partitionBy("id"))
    shared = written(shared.withColumn("alone", alone), "shared-prefixes")

    large = shared.filter(F.col("n") > LARGE)
    mixed = lambda k: F.xxhash64("id", F.lit(k))
    orders = [F.struct(F.col("alone") / F.col("size"), mixed(k)) for k in range(CENTRAL)] + [mixed(k) for k in range(PIVOTS - CENTRAL)]
    heads = large.groupBy("token").agg(*(F.min_by("id", x).alias(f"p{k}") for k, x in enumerate(orders)))
    texts = shared.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("alone").alias("alone_a"), F.col("end").alias("end_a")).distinct()
    stars = large.join(heads, "token").select("id", "size", "alone", "end", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("a"))
    stars = stars.filter(F.col("id") != F.col("a")).distinct().withColumnsRenamed({"id": "b", "size": "size_b", "alone": "alone_b", "end": "end_b"}).join(texts, "a")
    stars = written(stars.filter(_may_be_similar(similarity)).select("a", "b"), "stars")
    first = written(_decided(docs, stars, shingle, similarity), "star-links")
    labels = components(first)

    known = shared.join(labels, F.col("id") == F.col("node"), "left")
    known = written(known.select("token", "id", "size", "alone", "end", F.coalesce("label", "id").alias("label")), "labelled-prefixes")
    open_ = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    known = known.join(open_, "token", "left_semi")
    a, b = (known.select("token", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "alone", "end", "label"))) for x in "ab")
    pairs = a.join(b, "token").filter((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _may_be_similar(similarity))
    pairs = written(_enough(pairs, similarity), "pairs")
    return first.union(_decided(docs, pairs, shingle, similarity))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """node and label: for each distinct text (by hash) that is similar to others the smallest hash of its group.

    Texts are linked where their fingerprints are within the budget, by the trie self-join, and where their shingle sets have that similarity, which finds the near copies
    whose fingerprints are further apart. Equal texts are one from the start. A null text is the empty one; texts without words are alike.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.xxhash64(t).alias("id"), t.alias("text"))
    links = fingerprint_links(texts).union(written(similar_links(texts, shingle, similarity), "similar-links"))
    return components(links)


def fingerprint_links(texts: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """a, b: links between ids of texts (id, text; equal ids have equal texts) that connect all whose fingerprints are within the budget, and no others."""
    fps = written(fingerprints(texts, shingle, "id").distinct(), "text-fingerprints")
    heads = written(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    equal = fps.join(heads, "fp").filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    near = written(near_links(heads.select("fp"), budget), "near-fingerprints")
    side = lambda x: heads.select(F.col("fp").alias(f"fp_{x}"), F.col("head").alias(x))
    return written(equal.union(near.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b")), "fingerprint-links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the one with the smallest id (null ids last), then the smallest text hash.

    Null and blank texts are one group; rows that repeat id and text are one document, whatever their other columns; very long texts are
    compared whole; an empty table stays empty; further columns stay, whatever their names.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    hashed_rows = docs.select("doc_id", F.xxhash64(t).alias("hash"))
    labels = similar_groups(docs.select("text"))
    heads = hashed_rows.groupBy("hash").agg(F.min("doc_id").alias("head"))
    grouped = heads.join(labels, heads["hash"] == labels["node"], "left").select("hash", "head", F.coalesce("label", "hash").alias("label"))
    order = F.struct(F.col("head").isNull(), "head", "hash")
    keep = written(grouped.groupBy("label").agg(F.min_by("hash", order).alias("hash"), F.min_by("head", order).alias("head")), "kept-texts")
    text_hash, keep_hash, keep_id = fresh(docs, "text_hash", "keep_hash", "keep_id")
    keep = keep.select(F.col("hash").alias(keep_hash), F.col("head").alias(keep_id))
    keyed = docs.withColumn(text_hash, F.xxhash64(t))
    kept = keyed.join(keep, (keyed[text_hash] == keep[keep_hash]) & keyed["doc_id"].eqNullSafe(keep[keep_id]), "left_semi")
    # rows that repeat both id and text are one document: only those few are compared row by row
    again = hashed_rows.groupBy("doc_id", "hash").count().filter("count > 1").select(F.col("doc_id").alias(keep_id), F.col("hash").alias(keep_hash))
    again = written(again, "repeated-rows")
    same = kept["doc_id"].eqNullSafe(again[keep_id]) & (kept[text_hash] == again[keep_hash])
    one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", text_hash])
    return kept.join(again, same, "left_anti").union(one).select(*(F.col(f"`{c}`") for c in docs.columns))
