"""Merkle dataset manifest: one digest for a dataset, and for every row a proof that it is part of it.

The rows of a source, in ascending order of their ids, are the leaves of a tree in which every three consecutive nodes have one parent; the
sources' roots, ordered by name, are the leaves of one more such tree. The leaves are range-sorted, so each partition holds a run of them and can
close every group of siblings that lies inside it. What stays open is a sparse forest: nodes keyed by stratum, level and index. Two forests merge by
uniting their nodes and closing each group that is complete now (its size is known: three, or what is left at the end of the level), whatever the
order, so treeAggregate brings the forests of all partitions together. Only strata that lie in more than one partition take part: at most two for each
partition, with at most four open nodes a level. A stratum inside one partition closes there and stays distributed, so there can be any number of sources.

A second pass over the sorted leaves gives each row its siblings, from its own partition or, where a group crosses a border, from the merged forest.

Defined cases: a null in any column counts as `-` (an empty text does not); a null source is a source of its own, the first one; rows with
null ids come first; repeated ids are ordered by their leaves, repeated rows are leaves each by itself; very long texts are hashed where they are read;
an empty table gives an empty result; further columns do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.common import shuffle_partitions, written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """The number of nodes of each level of a tree of n leaves, the last one 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


#: A sparse forest: nodes by (stratum, level, index) that wait for siblings, those whose group is closed, and the number of leaves by stratum.
Forest = tuple[dict[tuple, str], dict[tuple, str], dict[object, int]]


def planted(forest: Forest, stratum: object, level: int, index: int, value: str, n: int) -> Forest:
    waiting, closed, sizes = forest
    sizes[stratum] = n
    waiting[stratum, level, index] = value
    _close(forest, stratum, level, index)
    return forest


def merged(a: Forest, b: Forest) -> Forest:
    """Associative and commutative; the empty forest is neutral."""
    if len(a[0]) + len(a[1]) < len(b[0]) + len(b[1]):
        a, b = b, a
    for mine, theirs in zip(a, b, strict=True):
        mine |= theirs
    for stratum, level, index in b[0]:
        _close(a, stratum, level, index)
    return a


def _close(forest: Forest, stratum: object, level: int, index: int) -> None:
    """Puts the parent of a node that has all its siblings in their place, and so on upwards."""
    waiting, closed, leaves = forest
    sizes = level_sizes(leaves[stratum])
    while level + 1 < len(sizes):
        parent = index // ARITY
        group = [(stratum, level, i) for i in range(ARITY * parent, min(ARITY * parent + ARITY, sizes[level]))]
        if any(k not in waiting for k in group):
            return
        values = [waiting.pop(k) for k in group]
        closed |= zip(group, values, strict=True)
        level, index = level + 1, parent
        waiting[stratum, level, index] = digest(values)


class Run:
    """Consecutive leaves of a stratum of n leaves, from index `base` on, with all nodes that they alone decide."""

    def __init__(self, stratum: object, base: int, n: int, leaves: list[str]):
        self.stratum, self.sizes = stratum, level_sizes(n)
        self.first, self.levels = [base], [leaves]
        for level, size in enumerate(self.sizes[:-1]):
            a, nodes = self.first[level], self.levels[level]
            b = a + len(nodes)
            begin, end = -(-a // ARITY), (-(-b // ARITY) if b == size else b // ARITY)
            self.first.append(begin)
            self.levels.append([digest(nodes[ARITY * j - a : ARITY * j + ARITY - a]) for j in range(begin, max(begin, end))])

    def open(self) -> Iterator[tuple[int, int, str]]:
        """level, index and value of the nodes whose groups are not closed here."""
        for level, nodes in enumerate(self.levels):
            a, top = self.first[level], level + 1 == len(self.sizes)
            up = () if top else range(self.first[level + 1], self.first[level + 1] + len(self.levels[level + 1]))
            for i, value in enumerate(nodes, a):
                if top or i // ARITY not in up:
                    yield level, i, value

    def paths(self, forest: Forest | None) -> tuple[list[list[tuple[str, str]]], str]:
        """For each leaf its siblings, level by level, and the root."""

        def node(level: int, i: int) -> str:
            at = i - self.first[level]
            if 0 <= at < len(self.levels[level]):
                return self.levels[level][at]
            key = (self.stratum, level, i)
            return forest[1][key] if key in forest[1] else forest[0][key]

        known: dict[tuple[int, int], list[tuple[str, str]]] = {}

        def path(level: int, i: int) -> list[tuple[str, str]]:
            if level + 1 == len(self.sizes):
                return []
            if (level, i) not in known:
                j = i // ARITY * ARITY
                pair = ("".join(node(level, k) for k in range(j, i)), "".join(node(level, k) for k in range(i + 1, min(j + ARITY, self.sizes[level]))))
                known[level, i] = [pair, *path(level + 1, i // ARITY)]
            return known[level, i]

        a = self.first[0]
        return [path(0, i) for i in range(a, a + len(self.levels[0]))], node(len(self.sizes) - 1, 0)


def paths(leaves: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """carried columns, stratum, path (siblings by level) and root (of its stratum) of every row of leaves (stratum, leaf, the columns of order and carried).

    A leaf's place is that among the leaves of its stratum by the columns of order; null strata are one stratum.
    """
    kind = {f.name: f.dataType.simpleString() for f in leaves.schema}
    parts = shuffle_partitions(leaves.sparkSession)
    by = ["stratum", *order, "leaf", "row"]
    names = list(dict.fromkeys(["stratum", "leaf", *order, *carried]))
    numbered = leaves.select(*names, F.monotonically_increasing_id().alias("row"))
    ranged = written(numbered.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "merkle-leaves")
    counts = ranged.groupBy("part", "stratum").agg(F.count("*").alias("m"))
    own = Window.partitionBy("stratum")
    counts = counts.select("part", "stratum", (F.sum("m").over(own.orderBy("part")) - F.col("m")).alias("base"), F.sum("m").over(own).alias("n"), F.count("*").over(own).alias("parts"))
    # strata that cross a border: at most two for each partition
    shared = {(r.part, r.stratum): (r.base, r.n) for r in counts.filter("parts > 1").collect()}
    ordered = ranged.repartition(parts, "part").sortWithinPartitions("part", *by)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Run, pa.Table]]:
        """Runs of leaves of one stratum and part, with their rows."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(batch.column("part").to_pylist(), batch.column("stratum").to_pylist(), strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if held and keys[a] != last:
                    yield run_of(last, held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held:
            yield run_of(last, held)

    def run_of(key: tuple, held: list[pa.RecordBatch]) -> tuple[Run, pa.Table]:
        table = pa.Table.from_batches(held)
        base, n = shared.get(key, (0, table.num_rows))
        return Run(key[1], base, n, table.column("leaf").to_pylist()), table

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, table in local(batches):
            key = (table.column("part")[0].as_py(), run.stratum)
            if key in shared:
                level, index, value = zip(*run.open(), strict=True)
                columns = [pa.array([run.stratum] * len(level), table.schema.field("stratum").type), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(value), pa.array([run.sizes[0]] * len(level), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["stratum", "level", "index", "value", "n"])

    forest = None
    if shared:
        nodes = ordered.select("part", "stratum", "leaf").mapInArrow(borders, f"stratum {kind['stratum']}, level int, index long, value string, n long")
        forest = nodes.rdd.treeAggregate(({}, {}, {}), lambda f, r: planted(f, *r), merged)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, table in local(batches):
            found, root = run.paths(forest)
            for at in range(0, len(found), 5000):
                some = found[at : at + 5000]
                rows = table.slice(at, len(some)).combine_chunks()
                pairs = [p for x in some for p in x]
                sides = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(sides, ["left", "right"]))
                columns = [rows.column(c).chunk(0) for c in ("stratum", *carried)]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array([root] * len(some), pa.string())], ["stratum", *carried, "path", "root"])

    schema = ", ".join(f"`{c}` {kind[c]}" for c in ("stratum", *carried))
    return ordered.select("part", *dict.fromkeys(["stratum", "leaf", *carried])).mapInArrow(place, f"{schema}, path {PATH}, root string")


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    fields = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.sha2(F.concat(*map(field, fields)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot (of the source), root, path (siblings by level up to root), claimed (the leaf of what is in store now), of every row of docs.

    tampered: the text that is in store now, if it may differ from the text that was entered.
    """
    rows = docs.select(F.col("source").alias("stratum"), "doc_id", leaf_of().alias("leaf"), leaf_of(tampered).alias("claimed"))
    placed = written(paths(rows, ["doc_id"], ["doc_id", "leaf", "claimed"]).withColumnRenamed("root", "subroot"), "merkle-paths")
    # one row for each source
    sources = placed.groupBy("stratum").agg(F.first("subroot").alias("leaf"))
    top = paths(sources.select(F.lit(0).alias("stratum"), F.col("stratum").alias("name"), "leaf"), ["name"], ["name"])
    top = top.select("name", F.col("path").alias("above"), "root")
    both = placed.join(top, placed["stratum"].eqNullSafe(top["name"]))
    return both.select("doc_id", F.col("stratum").alias("source"), "leaf", "subroot", "root", F.concat("path", "above").alias("path"), "claimed")


def verified(proofs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    sides = F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    out = proofs.withColumn("proof_sha256", F.sha2(sides, 256)).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified(manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))))


#: Levels that the SQL unrolls: enough for 3 ** LEVELS documents of a source and 3 ** SOURCE_LEVELS sources.
LEVELS, SOURCE_LEVELS = 9, 5


def _levels(prefix: str, start: str, levels: int) -> str:
    """CTEs prefix0, prefix1, ...: nodes s, i, d, c (nodes of the level) with their left and right siblings l and r."""
    out = []
    for k in range(levels + 1):
        source = start if k == 0 else f"(SELECT s, i // 3 AS i, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(c) + 2) // 3 AS c FROM {prefix}{k - 1} GROUP BY s, i // 3)"
        near = "OVER (PARTITION BY s, i // 3 ORDER BY i)"
        sides = f"coalesce(lag(d, 2) {near}, '') || coalesce(lag(d) {near}, '') AS l, coalesce(lead(d) {near}, '') || coalesce(lead(d, 2) {near}, '') AS r"
        out.append(f"{prefix}{k} AS (SELECT s, i, d, c, {sides} FROM {source})")
    return ",\n".join(out)


def _sql() -> str:
    field_ = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field_(text if c == "text" else c) for c in FIELDS) + ")"
    # crc32, a bit at a time: each byte of the id, then seven zeros
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"
    steps, prev = [], "docs"
    for p, levels, key in (("n", LEVELS, "i"), ("t", SOURCE_LEVELS, "j")):
        for k in range(levels):
            at = f"d.{key} // {3**k}"
            same = f"x.s IS NOT DISTINCT FROM d.s AND x.i = {at}" if p == "n" else f"x.i = {at}"
            grow = "CASE WHEN x.c > 1 THEN sha256(x.l || d.f || x.r) ELSE d.f END AS f, CASE WHEN x.c > 1 THEN d.proof || x.l || x.r ELSE d.proof END AS proof"
            steps.append(f"{p}s{k} AS (SELECT d.* REPLACE ({grow}) FROM {prev} d JOIN {p}{k} x ON {same})")
            prev = f"{p}s{k}"
    return f"""
WITH base AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claimed FROM documents),
docs0 AS (SELECT doc_id, source AS s, leaf, claimed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM base),
{_levels("n", "(SELECT s, i, leaf AS d, c FROM docs0)", LEVELS)},
sources AS (SELECT s, d AS subroot, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS j, count(*) OVER () AS c FROM n{LEVELS}),
{_levels("t", "(SELECT 0 AS s, j AS i, subroot AS d, c FROM sources)", SOURCE_LEVELS)},
docs AS (SELECT doc_id, docs0.s, leaf, i, j, subroot, claimed AS f, '' AS proof FROM docs0 JOIN sources ON docs0.s IS NOT DISTINCT FROM sources.s),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, (SELECT d FROM t{SOURCE_LEVELS}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT d FROM t{SOURCE_LEVELS}) AS verified FROM {prev}"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _sql()}
