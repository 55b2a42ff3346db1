"""Token ids of whole texts by the tokenizers library, a batch of texts at a time on Arrow and NumPy arrays.

The bytes of a batch are cut before white space that follows something else, and between a letter of Latin-1 and an ASCII mark behind it.
Both are borders of the vocabularies' own patterns, so the ids of a text are those of its pieces, one after the other. Arrow's
dictionary encoding finds the distinct pieces of a batch; each worker keeps the ids of those that it has seen (a bounded number of short
ones; those of longer pieces go with their batch) and hands the rest to the tokenizer, many in one string with one of the vocabulary's special tokens between them.
Pieces that may hold a special token's own text are encoded each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graticula.llm.common import kept

#: Bytes of the white space that pieces are cut at, and of the ASCII letters and marks between which they are cut.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK[0x30:0x3A] = False
MARK &= ~LETTER
#: After C3: the second byte of a letter of Latin-1.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
#: For tokenizers that lower-case and drop white space: A-Z lower-cased and all such white space a blank.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 0x20
FOLDED[9:14] = 0x20

#: Entries of a generation of the cache: when it is full, it becomes the older one, whose entries come back as they are met.
CACHED = 400_000
CACHED_LENGTH = 64
BATCH_BYTES = 4_000_000
#: A blank, if any, and letters of Latin-1 (capitals of ASCII only): one word to the vocabularies' patterns.
RUN, FOLDED_RUN = "^ ?[A-Za-zß-öø-ÿ]+$", "^ ?[a-zß-öø-ÿ]+$"
#: Pieces that go to the tokenizer in one string.
TOGETHER = 2_000


def _alphabet() -> dict[int, int]:
    """The character that stands for each byte in the models: itself if it can be printed, else one of those from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 0x100 + k for k, b in enumerate(hidden) if b != 10}


#: But for the line break, which stands between words here.
ALPHABET = _alphabet()
BLANKS = {0x20: ALPHABET[0x20]}


class BatchTokenizer:
    """ids(texts, end_id): the ids of each text, then end_id, as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.folds = one("A b") == one("a \n b")
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.openings = [s[:2].encode() for s in special]
        self.between = special[0]
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.known: dict[bytes, int] = {}
        self.store = Store(self.width)
        self.lasting = 0
        self.model, self.run = self.tokenizer.model, FOLDED_RUN if self.folds else RUN

    def ids(self, texts: pa.StringArray, end_id: int) -> pa.BinaryArray:
        """Of texts without nulls, of less than 2 GB."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        special = self._may_be_special(data.tobytes())
        bounds, last = _pieces(data, offsets - offsets[0], not special)
        if self.folds and not special:
            data = _folded(data)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        numbers = self._numbers(pieces.dictionary, special, np.array([end_id], self.dtype))
        found = self.store.array().take(pa.array(numbers).take(pieces.indices))
        self.store.cut(self.lasting)
        at = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
        ends = np.concatenate(([0], at[last + 1])).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), found.buffers()[2]])

    def _may_be_special(self, data: bytes) -> bool:
        return any(o in data for o in self.openings)

    def _numbers(self, dictionary: pa.BinaryArray, special: bool, end: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are in the store: behind `lasting` are those of this batch only."""
        if len(self.known) > CACHED:
            self._forget()
        out = np.fromiter(map(self.known.get, dictionary.to_pylist(), repeat(-1)), np.int64, len(dictionary))
        self.store.hits[out[out >= 0]] += 1
        new = np.flatnonzero(out < 0)
        pieces = dictionary.take(pa.array(new))
        short = pc.less_equal(pc.binary_length(pieces), CACHED_LENGTH).to_numpy(zero_copy_only=False)
        run = pc.match_substring_regex(pieces.view(pa.string()), self.run).to_numpy(zero_copy_only=False) & short
        ascii_ = pc.string_is_ascii(pieces.view(pa.string())).to_numpy(zero_copy_only=False)
        for some, alphabet in ((run & ascii_, BLANKS), (run & ~ascii_, ALPHABET)):
            if some.any():
                bare = pieces.filter(pa.array(some)).to_pylist()
                text = b"\n".join(bare).decode("latin-1")
                words = (text.replace(" ", "") if self.folds else text).translate(alphabet).split("\n")
                found = [[t.id for t in x] for x in map(self.model.tokenize, words)]
                self._learn(out, new[some], bare, np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64))
        rest = [(i, x) for i, x in zip(new[~run].tolist(), pieces.filter(pa.array(~run)).to_pylist(), strict=True)]
        plain = [(i, x) for i, x in rest if x and len(x) <= CACHED_LENGTH and not (special and self._may_be_special(x))]
        for at in range(0, len(plain), TOGETHER):
            some, bare = zip(*plain[at : at + TOGETHER], strict=True)
            ids = np.array(self._encode(self.between.join([x.decode() for x in bare])), self.dtype)
            edges = np.flatnonzero(ids == self.between_id)
            self._learn(out, np.array(some), bare, np.delete(ids, edges), np.diff(np.concatenate(([-1], edges, [len(ids)]))) - 1)
        self.lasting = self.store.n
        for i, x in rest:
            if out[i] < 0:
                ids = np.array(self._encode(x.decode()), self.dtype) if x else end
                out[i] = self.store.add(ids, np.array([len(ids)]))
        return out

    def _learn(self, out: np.ndarray, some: np.ndarray, bare: Sequence[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = self.store.add(ids, lengths)
        out[some] = np.arange(first, first + len(some))
        self.known.update(zip(bare, range(first, first + len(some)), strict=True))

    def _forget(self) -> None:
        """Keeps the half of the pieces that most batches held."""
        hits = self.store.hits[: self.store.n]
        keep = hits >= max(2, np.partition(hits, -CACHED // 2)[-CACHED // 2] + 1)
        number = np.cumsum(keep) - 1
        self.known = {x: int(number[i]) for x, i in self.known.items() if keep[i]}
        kept = self.store.array().filter(pa.array(keep))
        ends = np.frombuffer(kept.buffers()[1], np.int32, len(kept) + 1)
        self.store = Store(self.width)
        self.store.add(np.frombuffer(kept.buffers()[2], np.uint8)[: ends[-1]].view(self.dtype), np.diff(ends) // self.width)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Store:
    """Runs of ids, numbered as they are added."""

    def __init__(self, width: int):
        self.width, self.n, self.used = width, 0, 0
        self.ends, self.data, self.hits = np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint8), np.zeros(1 << 10, np.int32)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        first, raw = self.n, ids.view(np.uint8)
        if self.used + len(raw) >= 1 << 31:
            raise ValueError("the ids of a batch take 2 GB or more: give smaller batches or texts")
        while self.n + len(lengths) + 1 > len(self.ends):
            self.ends, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.ends, self.hits))
        while self.used + len(raw) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.ends[first + 1 : first + 1 + len(lengths)] = self.used + np.cumsum(lengths) * self.width
        self.hits[first : first + len(lengths)] = 1
        self.data[self.used : self.used + len(raw)] = raw
        self.n, self.used = first + len(lengths), self.used + len(raw)
        return first

    def cut(self, n: int) -> None:
        """Forgets all runs from number n on."""
        self.n, self.used = n, int(self.ends[n])
        if len(self.data) > max(1 << 24, 4 * self.used):
            self.data = self.data[: max(1 << 12, self.used)].copy()

    def array(self) -> pa.BinaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(self.ends), pa.py_buffer(self.data)])


def _folded(data: np.ndarray) -> np.ndarray:
    out = FOLDED[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] < 0x9F) & LATIN[data[latin]]]
    out[latin] += 0x20
    # capitals before what may begin a combining mark stay as they are: the two may be one letter
    at = np.flatnonzero(data[1:] >= 0xCC)
    out[at] = data[at]
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, at_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin and the last one ends, and for each text the number of its last piece: one of no bytes behind its end."""
    starts, ends = offsets[:-1], offsets[1:]
    cut = np.zeros(len(data), bool)
    if len(data):
        space = SPACE[data]
        cut[1:] = space[1:] & ~space[:-1]
        wide = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
        # white space beyond ASCII is U+0085 and U+00A0 (C2 ..) or three bytes from E1 to E3 on: behind what may be one nothing is cut
        two, three = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        cut[wide[(two == 0xC2) | ((two >= 0x80) & (three >= 0xE1) & (three <= 0xE3))]] = False
        if at_marks:
            letter = LETTER[data]
            letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
            cut[1:] |= MARK[data[1:]] & letter[:-1]
        cut[starts[starts < ends]] = True
    at = np.flatnonzero(cut)
    last = np.searchsorted(at, ends) + np.arange(len(ends))
    bounds = np.full(len(at) + len(ends) + 1, len(data), np.int32)
    inner = np.ones(len(bounds), bool)
    inner[-1] = inner[last] = False
    bounds[last], bounds[inner] = ends, at
    return bounds, last


def tokenizer(path: str) -> BatchTokenizer:
    """One for each process and file."""
    return kept(f"tokenizer of {path}", lambda: BatchTokenizer(path))


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """Runs of texts of about `most` bytes, with the number of the first; nulls are empty texts."""
    texts = texts.fill_null("").cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end


def flat(ids: pa.BinaryArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows one after the other, and how many each row has."""
    at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data.view(dtype) if len(data) else np.zeros(0, dtype), np.diff(at) // dtype.itemsize


def runs(values: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """The other way round: values cut into rows of the given lengths."""
    at = np.concatenate(([0], np.cumsum(lengths) * values.itemsize)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
