"""Suffix-array dedup against counting all windows, and the grouping construction against sorting."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticula.llm import suffixes
from graticula.llm.grouping import suffix_arrays


def brute(texts, window):
    seen = collections.Counter()
    for t in texts:
        seen.update(t[i : i + window] for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))))
        out.append((len(t), int(gone.sum()), [tuple(e) for e in edges.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest()))
    return out


def found(df, *args, **kw):
    rows = suffixes.deduplicated(df, *args, **kw).collect()
    assert all(r.n_spans == len(r.spans) for r in rows)
    return [(r.doc_id, (r.n_bytes, r.n_removed, sorted((s.begin, s.end) for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())) for r in rows]


def test_grouping_sorts_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(400):
        strings = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 50)), 0) for _ in range(rng.integers(1, 9))]
        strings += [np.append(np.ones(rng.integers(0, 30), int), 0), np.append(np.tile([2, 1], rng.integers(0, 20)), 0)]
        order, at = suffix_arrays(np.concatenate(strings), [len(s) for s in strings]), 0
        for s in strings:
            assert (order[at : at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda i: list(s[i:]))  # noqa: B023
            at += len(s)
    assert len(suffix_arrays(np.zeros(0, int), [])) == 0


def corpus(seed, letters):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdéfgh")[:letters], n))
    shared = [word(int(rng.integers(0, 300))) for _ in range(12)]
    texts = []
    for _ in range(200):
        t = word(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(len(shared)))]
            i, j = sorted(rng.integers(0, len(s) + 1, 2))
            t += s[i:j] + word(int(rng.integers(0, 5)))
        texts.append(t)
    return texts + texts[:20] + ["ab" * 200, "a" * 500, "", "é" * 100, "é" * 101, " \n", None]


@pytest.mark.parametrize(("window", "anchor", "block", "letters"), [(20, 4, 8, 8), (24, 5, 8, 2), (90, 6, 64, 5)])
@pytest.mark.parametrize("group", [128, 3])
def test_every_repeated_window_goes(spark, monkeypatch, window, anchor, block, letters, group):
    monkeypatch.setattr(suffixes, "GROUP", group)  # 3: most cores are dealt anew
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    texts = corpus(window, letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute([(t or "").encode() for t in texts], window)
    assert sum(w[1] for w in want) > 10_000
    assert dict(found(df, window, anchor, block)) == dict(enumerate(want))


def test_default_window_long_texts_and_repeated_rows(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefghijkl \n"), n))
    passage = word(400)
    long = word(600_000)
    texts = [word(50) + passage + word(60), word(700) + passage[1:] + "#", passage, "x" + passage[:399] + "y", long, word(10) + long[300_000:300_450], passage[:399]]
    rows = [(k, t, 1, "c", 2) for k, t in enumerate(texts)] + [(2, passage, 1, "c", 2), (None, None, None, None, None), (None, "", 1, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int, fringe string, spans int").repartition(4)
    want = brute([(r[1] or "").encode() for r in rows], 400)
    assert sorted(map(str, found(df))) == sorted(map(str, zip([r[0] for r in rows], want, strict=True)))
    assert [w[1] for w in want[:7]] == [400, 0, 400, 0, 450, 450, 0]


def test_empty_tables_and_parameters(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert suffixes.deduplicated(df).count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", "short")], "doc_id string, text string")
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.deduplicated(nulls).collect()} == {("a", 0, 0), ("b", 5, 0)}
    with pytest.raises(ValueError, match="block"):
        suffixes.deduplicated(df, block=16)


def test_query_is_brute_force_on_whole_texts(spark):
    rng = np.random.default_rng(17)
    lines = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(70)) for _ in range(6)]
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 4))) + f" tail {k % 40}" for k in range(80)]
    folder = spark.conf.get("spark.checkpoint.dir") + "/suffixes"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(folder + "/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op13_suffix_groups(spark, folder).collect()}
    assert got == {k: (n, gone, len(spans), digest) for k, (n, gone, spans, digest) in enumerate(brute([t.encode() for t in texts], 400))}
