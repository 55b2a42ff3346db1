"""64-bit hashes of the words and n-grams of many texts at once, on arrays.

A word's hash is a polynomial over its bytes with a random value for each byte, modulo 2 ** 64: differences of one running sum give it for
all words of a batch. Equal words have equal hashes in every text, batch and process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graticula.llm.common import kept

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 18  # bytes that are hashed at once


def _state() -> dict:
    """Tables, built once for each process."""
    known = kept("ngram tables", dict)
    if not known:
        known["value"] = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
        known["powers"] = known["inverse"] = np.ones(1, np.uint64)
    return known


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = _state()
    if len(state["powers"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            state[name] = np.multiply.accumulate(table)
    return state["powers"], state["inverse"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (no nulls), in order, A-Z lower-cased, and the number of words of each text."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    word = ~SPACE_BYTES[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = at[(at > 0) & (at < len(data))]  # words end with their text
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(begins), np.uint64)
    first = 0
    while first < len(begins):
        base = begins[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SEGMENT)))
        powers, inverse = _powers(int(ends[last - 1] - base) + 1)
        part = data[base : ends[last - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_state()["value"][part] * powers[: len(part)], out=sums[1:])
        s, e = begins[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out, np.diff(np.searchsorted(begins, at))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of one text."""
    return batch_hashes([text])[0]


def batch_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed(pa.array(texts, pa.string()))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words begin none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k] + np.uint64(k))
    return h


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """For n-grams of concatenated texts: True where all n words are of one text."""
    total = int(counts.sum())
    ok = np.ones(max(0, total - n + 1), bool)
    ends = np.cumsum(counts)
    for k in range(1, n):
        at = ends - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    # a text shorter than n: starts before it may reach over it, and its own starts reach on
    starts = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)[: len(ok)]
    return ok & (np.arange(len(ok)) + n <= ends[owner]) & (np.arange(len(ok)) >= starts[owner])
