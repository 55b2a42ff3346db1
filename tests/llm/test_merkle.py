"""Merkle manifests against trees built one list at a time."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from graticula.llm import merkle

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and for each leaf its siblings left and right, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return (nodes or [None])[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, inner = [], {}
    for s in sources:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in mine])
        roots.append(root)
        inner[s] = list(zip(mine, paths, strict=True))
    root, above = tree(roots)
    out = []
    for k, s in enumerate(sources):
        for r, path in inner[s]:
            whole = path + above[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for a, b in whole:
                now = H(a, now, b)
            out.append((r[0], leaf(r), roots[k], root, H(*(x for p in whole for x in p)), now, now == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", "é", "ab", "aB", "z", *(f"s{i}" for i in range(30))])
        text = rng.choice([None, "", "plain", "two\nlines", "\n", "x\r\ny", "ü\n" * 40])
        out.append((rng.choice([k, k, k, 7, None]), source, rng.choice([None, "en"]), rng.choice([None, 3]), text))
    return out + out[:5] + [(900_000, "long", "en", 1, "word\n" * 200_000)]


def query(spark, df, name):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/merkle-{name}"
    df.write.parquet(folder + "/documents.parquet")
    return merkle.op12_merkle_manifest(spark, folder)


def test_manifest_is_the_serial_one(spark):
    for n in (0, 1, 2, 3, 4, 40, 700):
        rows = rows_of(n, n) if n else []
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        df = df.withColumns({"stratum": F.lit(1), "leaf": F.lit("x"), "part": F.lit(2), "row": F.lit(3), "path": F.lit("p")})
        got = [tuple(r) for r in query(spark, df, n).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_source_over_all_partitions(spark):
    rows = [(k, "only", "en", 1, f"t{k}") for k in range(1000)]
    got = [tuple(r) for r in query(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), "one").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_forests_merge_in_any_order():
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 9, 10, 27, 100, 244):
        leaves = [H(str(k)) for k in range(n)]
        root, _ = tree(leaves)
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, 6)))
        pieces = [(a, b) for a, b in zip([0, *cuts], [*cuts, n], strict=True) if a < b]
        forests = []
        for a, b in pieces:
            f = ({}, {}, {})
            for level, index, value in merkle.Run("s", a, n, leaves[a:b]).open():
                f = merkle.planted(f, "s", level, index, value, n)
            assert len(f[0]) <= 4 * len(merkle.level_sizes(n))
            forests.append(f)
        rng.shuffle(forests)
        while len(forests) > 1:
            forests.append(merkle.merged(forests.pop(rng.randrange(len(forests))), forests.pop(rng.randrange(len(forests)))))
        assert forests[0][0] == {("s", len(merkle.level_sizes(n)) - 1, 0): root}
