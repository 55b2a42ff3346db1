"""Suffix-array dedup: removes every byte that a string of `window` bytes covers which also starts anywhere else.

Whether a string of `window` bytes starts twice shows in a suffix array, but one array of a whole corpus fits no task. So the suffixes are dealt out
by content, and each group of suffixes that can be equal has an array of its own:

* The anchor of a window is the n-gram of `anchor` bytes in it with the smallest hash. Equal windows have their anchors at the same place. Windows
  whose anchor occurs once in the corpus are unique and dropped; a bitmap of a fixed size holds the others (its false hits cost work only).
* The windows of an anchor are cut into blocks of `block` neighbouring starts. All windows of a block hold its core, the bytes that they share, so only
  blocks with equal cores (128 bits of hash) can hold equal windows. A core travels as one symbol: the string of a block is the bytes before
  its core, the symbol, and the bytes behind it, and two windows are equal where `block` symbols of such strings are.
* Equal strings are copies: they are counted. The different strings of a core are concatenated, and their suffix array is built by
  grouping (grouping.py): windows next to each other in it are compared. Only blocks whose core has different strings bring their bytes along, once a batch.
* A core with more than GROUP different strings (a passage that many documents share) is dealt anew: its blocks are cut into eight, whose
  cores are longer. Blocks of one start are their cores alone, counted with partial sums. So no task gets a group that grows with the data.

The marks go back to their texts, and each text's bytes outside of them are kept. Only texts with marks are shuffled.

Defined cases: a null text counts as empty; texts shorter than the window keep all bytes; copies of a text, also in one row's own text, are removed
all, the first one included; repeated ids and rows are ordinary rows; very long texts are searched in segments that overlap by a window and are
cut in one task as a whole; an empty table gives an empty result; further columns do not take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.bitmaps import bitmap, passing
from graticula.llm.common import kept, shuffle_partitions, written
from graticula.llm.grouping import _ragged, suffix_arrays
from graticula.llm.ngrams import mixed
from graticula.llm.tokens import runs, slices

WINDOW, ANCHOR, BLOCK = 400, 32, 64
#: Different strings of a core that one suffix array takes.
GROUP = 128
#: Leading bits of anchors' hashes in the bitmap: 16 MB.
BITS = 27
SEGMENT = 1 << 18  # starts that are searched at once
BATCH_BYTES = 4_000_000
SYMBOLS = 2_000_000  # symbols of a batch of suffix arrays
SALTS = 8
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)

BLOCKS = "k1 long, k2 long, s1 long, s2 long, t0 int, fringe binary"
TEXTS = "h1 long, h2 long, at long"


class Hashes:
    """Hashes of all substrings of data, by differences of two running sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, bases: int = 2):
        self.sums, self.inverse = [], []
        for values, powers, inverse in _tables(len(data) + 1)[:bases]:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * powers[: len(data)], out=total[1:])
            self.sums.append(total)
            self.inverse.append(inverse)

    def of(self, begin: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
        return mixed((self.sums[base][end] - self.sums[base][begin]) * self.inverse[base][begin])

    def grams(self, n: int) -> np.ndarray:
        total = self.sums[0]
        return mixed((total[n:] - total[:-n]) * self.inverse[0][: len(total) - n])


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each base random values of the bytes, the base's powers and those of its inverse, built once for each process."""
    state = kept("substring tables", dict)
    if state.get("n", 0) < n:
        state["n"] = 1 << (n - 1).bit_length()
        rng, state["tables"] = np.random.default_rng(71), []
        for base in _BASES:
            powers = []
            for b in (base, pow(base, -1, 1 << 64)):
                table = np.full(state["n"], b, np.uint64)
                table[0] = 1
                powers.append(np.multiply.accumulate(table))
            state["tables"].append((rng.integers(1, 2**64 - 1, 256, dtype=np.uint64), *powers))
    return state["tables"]


def anchors(data: np.ndarray, text: np.ndarray, hashes: Hashes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first start, number of starts, the anchor's place and its hash. text: the text of each byte."""
    n = len(data) - window + 1
    if n <= 0:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    grams = hashes.grams(anchor)
    bits = int(len(grams)).bit_length()
    low = np.uint64((1 << bits) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first place counts
    span, width = 1, window - anchor + 1
    while 2 * span <= width:
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least[: span - width] = np.minimum(least[: span - width], least[width - span :])
    at = (least[:n] & low).astype(np.int64)
    inside = text[:n] == text[window - 1 :]
    change = np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])))
    first = np.flatnonzero(change)
    count = np.diff(np.concatenate((first, [n])))
    ok = inside[first]
    first, count = first[ok], count[ok]
    return first, count, at[first], grams[at[first]]


def cut(first: np.ndarray, count: np.ndarray, at: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with their anchors, cut into blocks: number of the run, number of the block, first start, number of starts."""
    far, near = (at - first) // block, (at - first - count + 1) // block
    pieces = far - near + 1
    run = np.repeat(np.arange(len(first)), pieces)
    b = np.repeat(far, pieces) - _ragged(np.zeros(len(pieces), np.int64), pieces)
    begin = np.maximum(first[run], at[run] - (b + 1) * block + 1)
    end = np.minimum((first + count)[run], at[run] - b * block + 1)
    return run, b, begin, end - begin


class Blocks:
    """Blocks of the windows whose anchor may occur twice: begin (the first window), n (windows) and t0.

    A block's windows are numbered t from t0 on; window t begins block - 1 - t bytes before the core.
    """

    def __init__(self, data: np.ndarray, text: np.ndarray, flags: np.ndarray, window: int, anchor: int, block: int, bases: int = 2):
        self.data, self.hashes = data, Hashes(data, bases)
        first, count, at, gram = anchors(data, text, self.hashes, window, anchor)
        hit = passing(flags, gram)
        first, count, at = first[hit], count[hit], at[hit]
        run, b, self.begin, self.n = cut(first, count, at, block)
        self.core = at[run] - b * block
        self.core_end = self.core + window - block + 1
        self.t0 = block - 1 - (self.core - self.begin)
        self.end = self.begin + self.n - 1 + window
        self.mark = b.astype(np.uint64) << np.uint64(32)

    def cores(self, base: int) -> np.ndarray:
        return mixed(self.hashes.of(self.core, self.core_end, base) + self.mark)

    def wholes(self, base: int) -> np.ndarray:
        return mixed(self.hashes.of(self.begin, self.end, base) + self.mark + self.t0.astype(np.uint64) + np.uint64(1))

    def fringes(self, some: np.ndarray) -> pa.BinaryArray:
        """The bytes before the core, then those behind it."""
        begin, core, core_end, end = (x[some] for x in (self.begin, self.core, self.core_end, self.end))
        before, behind = core - begin, end - core_end
        places = _ragged(np.stack((begin, core_end), 1).ravel(), np.stack((before, behind), 1).ravel())
        return runs(self.data[places], before + behind)


def _segments(texts: pa.StringArray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Overlapping segments: where one begins, its bytes, the text of each byte, and where each text begins."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    for x in range(0, max(0, len(data) - window + 1), SEGMENT):
        part = data[x : x + SEGMENT + window - 1]
        inner = np.searchsorted(offsets, [x, x + len(part) - 1], "right") - 1
        own = np.arange(inner[0], inner[1] + 1)
        lengths = np.minimum(offsets[own + 1], x + len(part)) - np.maximum(offsets[own], x)
        yield x, part, np.repeat(own.astype(np.int32), lengths), offsets


def anchor_counts(docs: DataFrame, text: str, window: int, anchor: int) -> DataFrame:
    """anchor, n: how many runs of windows have it, in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0), BATCH_BYTES):
                for _, data, own, _ in _segments(texts, window):
                    found, n = np.unique(anchors(data, own, Hashes(data, 1), window, anchor)[3], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def core_strings(docs: DataFrame, text: str, flags: np.ndarray, window: int, anchor: int, block: int) -> DataFrame:
    """k1, n, low, high: of each core how many blocks hold it, and the least and greatest hash of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0), BATCH_BYTES):
                for _, data, own, _ in _segments(texts, window):
                    found = Blocks(data, own, flags, window, anchor, block, 1)
                    core, whole = found.cores(0), found.wholes(0).view(np.int64)
                    order = np.lexsort((whole, core))
                    core, whole = core[order], whole[order]
                    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(core)), bool), core[1:] != core[:-1])))
                    n = np.diff(np.concatenate((first, [len(core)])))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core[first].view(np.int64), n, whole[first], whole[first + n - 1])], ["k1", "n", "low", "high"])

    found = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "k1 long, n long, low long, high long")
    return found.groupBy("k1").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def text_blocks(docs: DataFrame, text: str, flags: tuple[np.ndarray, np.ndarray, np.ndarray], window: int, anchor: int, block: int) -> DataFrame:
    """The blocks of all texts whose anchor and core may occur twice, with the text's hashes (h1, h2), the place and number of windows, and the copies of the text in the batch.

    Where the core may have different strings, the first block of each string in a segment brings k1, k2, t0 and the fringe along.
    """
    seen, twice, different = flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), BATCH_BYTES):
                copies = texts.dictionary_encode()
                index = copies.indices.to_numpy()
                row, n = np.unique(index, return_index=True)[1] + at, np.bincount(index, minlength=len(copies.dictionary))
                h = [batch.column(c).to_numpy()[row] for c in (0, 1)]
                for x, data, own, offsets in _segments(copies.dictionary, window):
                    found = Blocks(data, own, seen, window, anchor, block)
                    core = found.cores(0)
                    hit = passing(twice, core)
                    s1, s2 = (found.wholes(k)[hit].view(np.int64) for k in (0, 1))
                    mine, begin = own[found.begin[hit]], found.begin[hit]
                    several = passing(different, core[hit])
                    firsts = several[np.unique(s1[several], return_index=True)[1]]
                    place = np.full(len(hit), -1)
                    place[firsts] = np.arange(len(firsts))
                    place = pa.array(place, mask=place < 0)
                    with_ = hit[firsts]
                    extra = [pa.array(y).take(place) for y in (core[with_].view(np.int64), found.cores(1)[with_].view(np.int64), found.t0[with_].astype(np.int32))]
                    columns = [*extra[:2], s1, s2, extra[2], found.fringes(with_).take(place), h[0][mine], h[1][mine], begin + x - offsets[mine], found.n[hit], n[mine]]
                    names = ["k1", "k2", "s1", "s2", "t0", "fringe", "h1", "h2", "at", "windows", "n"]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = docs.select(*text_hashes(t), t.alias("t")).filter(F.octet_length("t") >= window)
    return hashed.mapInArrow(run, f"{BLOCKS}, {TEXTS}, windows long, n long")


def text_hashes(t) -> tuple:
    return F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")


def repeated_windows(t0: np.ndarray, fringe: pa.BinaryArray, core: np.ndarray, block: int) -> np.ndarray:
    """For different strings in the order of their cores: a mask of the windows (bit u: window t0 + u) that occur in another one."""
    at = np.frombuffer(fringe.buffers()[1], np.int32, len(fringe) + 1, 4 * fringe.offset).astype(np.int64)
    data = np.frombuffer(fringe.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    windows = size - block + 2
    mask = np.zeros(len(size), np.uint64)
    new = np.concatenate(([True], core[1:] != core[:-1]))
    of = np.cumsum(new) - 1
    some = np.flatnonzero(np.bincount(of)[of] > 1)
    if not len(some):
        return mask.view(np.int64)
    # strings: bytes + 3, the core as 2, an end as 1, and 0 behind the last string of a core
    group = of[some]
    final = np.concatenate((group[1:] != group[:-1], [True]))
    length = size[some] + 2 + final
    start = np.cumsum(length) - length
    symbols = np.ones(int(length.sum()), np.uint16)
    before = block - 1 - t0[some]
    bare = data[_ragged(at[:-1][some], size[some])].astype(np.uint16) + 3
    shift = _ragged(np.zeros(len(some), np.int64), size[some])
    symbols[np.repeat(start, size[some]) + shift + (shift >= np.repeat(before, size[some]))] = bare
    symbols[start + before] = 2
    symbols[(start + length - 1)[final]] = 0
    order = suffix_arrays(symbols, np.bincount(np.cumsum(np.concatenate(([True], final[:-1]))) - 1, length).astype(np.int64))
    # windows in the order of the array, next to each other in the same core: equal where `block` symbols are
    where = np.full(len(symbols), -1, np.int64)
    n = windows[some]
    u = _ragged(np.zeros(len(some), np.int64), n)
    where[np.repeat(start, n) + u] = np.repeat(np.arange(len(some)), n)
    order = order[where[order] >= 0]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[where[a]] == group[where[b]])
    view = np.lib.stride_tricks.sliding_window_view(symbols, block)
    same = np.zeros(len(order), bool)
    for x in range(0, len(near), 1 << 16):
        k = near[x : x + (1 << 16)]
        equal = k[(view[a[k]] == view[b[k]]).all(1)]
        same[equal] = same[equal + 1] = True
    hit = order[same]
    bits = np.uint64(1) << (hit - start[where[hit]]).astype(np.uint64)
    np.bitwise_or.at(mask, some[where[hit]], bits)
    return mask.view(np.int64)


def decided(strings: DataFrame, block: int) -> DataFrame:
    """s1, s2 and the mask of the windows that occur in other strings, of all different strings (BLOCKS) that have some."""
    strings = written(strings, "block-strings")
    flags = bitmap(strings.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP), "k1")
    large = bool(flags.any())

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        amount = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if large:
                batch = batch.filter(pa.array(_others(flags, batch.column(0))))
            held.append(pa.Table.from_batches([batch]))
            amount += batch.num_rows * 2 * block
            if amount >= SYMBOLS:
                table = pa.concat_tables(held)
                k = table.column(0).to_numpy()
                end = int(np.searchsorted(k, k[-1])) if len(k) else 0  # sorted by k1: the last core may go on
                if end:
                    yield masks(table.slice(0, end))
                    held, amount = [table.slice(end)], (len(k) - end) * 2 * block
        if held:
            yield masks(pa.concat_tables(held))

    def masks(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        k1, k2, s1, s2, t0, fringe = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        k1, k2 = k1.to_numpy(), k2.to_numpy()
        core = np.cumsum(np.concatenate(([False], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))[: len(k1)]
        mask = repeated_windows(t0.to_numpy(), fringe, core, block) if len(k1) else np.zeros(0, np.int64)
        some = pa.array(np.flatnonzero(mask))
        return pa.RecordBatch.from_arrays([s1.take(some), s2.take(some), pa.array(mask).take(some)], ["s1", "s2", "mask"])

    parts = shuffle_partitions(strings.sparkSession)
    dealt = strings.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2")
    out = dealt.select(*COLUMNS).mapInArrow(arrays, "s1 long, s2 long, mask long")
    if not large:
        return out
    finer = block // 8
    children = written(strings.select(*COLUMNS).mapInArrow(lambda batches: _refined(batches, flags, block, finer), f"{BLOCKS}, p1 long, p2 long, shift int"), "finer-blocks")
    if finer == 1:  # the core is the window
        windows = children.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("s1", "s2", F.lit(1).cast("long").alias("mask"))
    else:
        windows = decided(children.select(*COLUMNS).distinct(), finer).unionByName(copied(children, F.lit(1)))
        windows = windows.groupBy("s1", "s2").agg(F.bit_or("mask").alias("mask"))
    windows = written(windows, "finer-masks")
    found = children.select("s1", "s2", "p1", "p2", "shift", clipped_to(finer)).join(windows, ["s1", "s2"])
    found = found.groupBy("p1", "p2").agg(F.bit_or(F.expr("shiftleft(mask & clip, shift)")).alias("mask"))
    return out.unionByName(found.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), "mask"))


COLUMNS = ("k1", "k2", "s1", "s2", "t0", "fringe")


def clipped_to(block: int) -> F.Column:
    """A bit for each window of a string."""
    return F.expr(f"shiftrightunsigned(-1L, 64 - (octet_length(fringe) - {block} + 2))").alias("clip")


def copied(rows: DataFrame, n: F.Column) -> DataFrame:
    """s1, s2 and a mask of all windows, of the strings that rows hold more than once."""
    return rows.groupBy("s1", "s2").agg(F.sum(n).alias("n")).filter("n > 1").select("s1", "s2", F.lit(-1).cast("long").alias("mask"))


def _others(flags: np.ndarray, keys: pa.Array) -> np.ndarray:
    out = np.ones(len(keys), bool)
    out[passing(flags, keys.to_numpy().view(np.uint64))] = False
    return out


def _refined(batches: Iterator[pa.RecordBatch], flags: np.ndarray, block: int, finer: int) -> Iterator[pa.RecordBatch]:
    """The blocks of large cores cut into blocks of `finer` starts: p1, p2 (the string they are cut from) and shift (their first window in it)."""
    for batch in batches:
        batch = batch.filter(pa.array(~_others(flags, batch.column(0))))
        if not batch.num_rows:
            continue
        k1, k2, s1, s2, t0 = (batch.column(c).to_numpy() for c in range(5))
        fringe = batch.column(5)
        at = np.frombuffer(fringe.buffers()[1], np.int32, len(fringe) + 1, 4 * fringe.offset).astype(np.int64)
        data = np.frombuffer(fringe.buffers()[2], np.uint8)[at[0] : at[-1]]
        at -= at[0]
        before, windows = block - 1 - t0, np.diff(at) - block + 2
        first, last = t0 // finer, (t0 + windows - 1) // finer
        pieces = (last - first + 1).astype(np.int64)
        run = np.repeat(np.arange(len(t0)), pieces)
        c = _ragged(first.astype(np.int64), pieces)  # windows c * finer to c * finer + finer - 1
        begin, end = np.maximum(t0[run], c * finer), np.minimum((t0 + windows)[run], (c + 1) * finer)
        # places in the fringe: before the core, window t begins at t - t0, and it ends t bytes behind the core
        left = at[:-1][run] + begin - t0[run]
        core = at[:-1][run] + (c + 1) * finer - 1 - t0[run]
        core = np.minimum(np.maximum(core, left), (at[:-1] + before)[run])
        middle = (at[:-1] + before)[run]
        core_end, right = middle + c * finer, middle + end - 1
        hashes = Hashes(data)
        mark = (c.astype(np.uint64) + np.uint64(1)) << np.uint64(40)
        keys = []
        for k, own in enumerate((k1, k2)):
            parent = own[run].view(np.uint64)
            keys.append(mixed(parent + mark + hashes.of(core, middle, k) + mixed(hashes.of(middle, core_end, k) + (middle - core).astype(np.uint64))))
        wholes = [mixed(keys[k] + hashes.of(left, core, k) * np.uint64(3) + mixed(hashes.of(core_end, right, k) + (begin - c * finer).astype(np.uint64) + np.uint64(7))) for k in (0, 1)]
        places = _ragged(np.stack((left, core_end), 1).ravel(), np.stack((core - left, right - core_end), 1).ravel())
        out = [*(x.view(np.int64) for x in keys + wholes), (begin - c * finer).astype(np.int32), runs(data[places], core - left + right - core_end)]
        out += [s1[run], s2[run], (begin - t0[run]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [*COLUMNS, "p1", "p2", "shift"])


def covered(places: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Maximal runs of bytes (begin, end) that the marked windows cover."""
    bit = (masks.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    row, u = np.nonzero(bit)
    start = np.unique(places[row] + u)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > start[:-1] + window)))
    return np.stack((start[new], start[np.concatenate((new[1:] - 1, [len(start) - 1]))] + window), 1)


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of struct begin, end: the removed runs) and kept (the other bytes) of every row."""
    if block not in (8, 64) or not 1 <= anchor <= window - block + 1:
        raise ValueError("block must be 8 or 64, and the anchor fit into a core")
    seen = bitmap(anchor_counts(docs, text, window, anchor).filter("n > 1"), "anchor", bits)
    cores = written(core_strings(docs, text, seen, window, anchor, block).filter("n > 1"), "cores")
    twice, different = bitmap(cores, "k1", bits), bitmap(cores.filter("low < high"), "k1", bits)
    rows = written(text_blocks(docs, text, (seen, twice, different), window, anchor, block), "text-blocks")
    strings = rows.filter(F.col("fringe").isNotNull()).select(*COLUMNS).distinct()
    masks = decided(strings, block).unionByName(copied(rows, F.col("n"))).groupBy("s1", "s2").agg(F.bit_or("mask").alias("mask"))
    # a string that many texts hold: both sides of the join are tables, so AQE cuts the skewed one
    masks = written(masks, "string-masks")
    marks = rows.select("s1", "s2", "h1", "h2", "at", "windows").join(masks, ["s1", "s2"])
    marks = marks.withColumn("mask", F.expr("mask & shiftrightunsigned(-1L, int(64 - windows))"))
    # very long texts have many marks, but not more than bytes
    marks = marks.groupBy("h1", "h2").agg(F.collect_set(F.struct("at", "mask")).alias("marks"))
    marks = written(marks, "text-marks")
    flagged = bitmap(marks, "h1", 24)

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kind = docs.schema[doc_id].dataType.simpleString()
    all_ = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("t"), *text_hashes(t))

    def chosen(marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                others = _others(flagged, batch.column(2))
                yield batch.filter(pa.array(others != marked))

        return all_.mapInArrow(run, f"doc_id {kind}, t string, h1 long, h2 long")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary())
            out, spans_out = [], []
            for i in range(batch.num_rows):
                whole = raw[i].as_buffer()
                marks_ = batch.column(2)[i]
                if not marks_.is_valid:
                    spans = np.zeros((0, 2), np.int64)
                else:
                    found = marks_.values
                    spans = covered(found.field("at").to_numpy(), found.field("mask").to_numpy(), window)
                edges = np.concatenate(([0], spans.ravel(), [whole.size]))
                out.append(b"".join([whole[a:b].to_pybytes() for a, b in edges.reshape(-1, 2).tolist()]))
                spans_out.append([{"begin": a, "end": b} for a, b in spans.tolist()])
            size = pa.array([len(x) for x in out], pa.int64())
            kept_, span_type = pa.array(out, pa.binary()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), size, pa.array(spans_out, span_type), kept_], ["doc_id", "n_bytes", "n_kept", "spans", "kept"])

    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    found = chosen(True).withColumn("salt", spread).join(marks.select("*", salts), ["h1", "h2", "salt"], "left")
    found = found.select("doc_id", "t", "marks", F.octet_length("t").cast("long").alias("n"))
    spans_type = "array<struct<begin: long, end: long>>"
    found = found.mapInArrow(drop, f"doc_id {kind}, n_bytes long, n_kept long, spans {spans_type}, kept binary")
    clean = chosen(False).select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.octet_length("t").cast("long").alias("n_kept"), F.expr(f"cast(array() as {spans_type})").alias("spans"), F.col("t").cast("binary").alias("kept"))
    both = found.unionByName(clean)
    return both.select("doc_id", "n_bytes", (F.col("n_bytes") - F.col("n_kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")


def op13_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_groups": op13_suffix_groups}
