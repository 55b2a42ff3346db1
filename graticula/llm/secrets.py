"""Secret scans with multipart credential linking.

Base patterns find strong secrets. Weak candidates are access identifiers (named ids), secret-looking strings and endpoints: each
alone is reported only if a complementary part lies within `scope` code points in the same document. The parts are rows; an
interval join on (document, range of positions), against one row of extremes for each range and type, finds whether a complementary
part is near, without forming pairs. Matches and positions come from split() and regexp_extract_all(): no Python runs.

Defined cases: a null text counts as empty; a document without findings has zero counts and empty spans; repeated rows, also with the
same id, are scanned each by itself; an empty table gives an empty result; further columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.common import fresh, written

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")

#: Weak candidates by kind: pattern and the type of part.
WEAK = {
    "ident": (r"(?i)\b(?:access_?key_?id|client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", "id"),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}", "secret"),
    "endpoint": (r"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", "endpoint"),
}
#: The type of part that each base kind is, and the types of which one must be near for a weak part of a type.
BASE_TYPES = {"assign": "secret", "access": "id", "hex": "secret"}
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SPAN = "array<struct<start:int,end:int,kind:string>>"


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, end, kind) of all matches, leftmost and not overlapping, in code points; keep: a test of the matched string."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    lengths = F.arrays_zip(between.alias("gap"), F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("ok"))).alias("m"))
    start = lambda acc, x: acc["at"] + x["gap"]
    folded = F.aggregate(
        F.filter(lengths, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (start(acc, x) + x["m"]["n"]).alias("at"),
            F.when(
                x["m"]["ok"],
                F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + x["m"]["n"]).alias("end"), F.lit(kind).alias("kind")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), folded).otherwise(F.array().cast(SPAN))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    kinds = [*BASE_KINDS, *WEAK]
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, base (spans of the base kinds) and spans (with the weak ones that are linked)."""
    if scope < 1:
        raise ValueError("scope must be positive")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    found = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        matches(t, ASSIGN, "assign", long_enough).alias("assign"),
        matches(t, ACCESS, "access").alias("access"),
        matches(t, HEX, "hex").alias("hex"),
        *(matches(t, pattern, kind).alias(kind) for kind, (pattern, _) in WEAK.items()),
    )
    # positions are known from here on: the texts are read once, and only rows of spans are shuffled
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    inside = lambda s: F.exists(F.concat("assign", "access", "hex"), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    weak = reduce(lambda a, b: F.concat(a, b), [F.filter(kind, lambda s: ~inside(s)) for kind in WEAK])
    typed = lambda kind, type_, strong, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(type_).alias("type"), F.lit(strong).alias("strong")))
    parts = found.filter(F.size(F.concat(*WEAK)) > 0).select(
        "row",
        F.inline(
            F.concat(
                *(typed(kind, type_, True, F.col(kind)) for kind, type_ in BASE_TYPES.items()),
                *(typed(kind, type_, False, F.filter(kind, lambda s: ~inside(s))) for kind, (_, type_) in WEAK.items()),
            )
        ),
    )
    parts = parts.withColumn("range", F.floor(F.col("start") / scope))
    extremes = parts.groupBy("row", "range", "type").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.create_map(*(x for a, bs in COMPLEMENTS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    asked = parts.filter(~F.col("strong")).select(
        "row", "start", "end", "kind", F.explode(needs[F.col("type")]).alias("type"), F.col("range").alias("own")
    ).withColumn("range", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    linked = asked.join(extremes, ["row", "range", "type"]).filter(near).groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    base = _ordered(F.concat(*BASE_KINDS))
    out = found.join(linked, "row", "left").select(
        "row", "doc_id", base.alias("base"), F.coalesce("added", F.array().cast(SPAN)).alias("added"), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS)
    )
    return out.withColumn("spans", _ordered(F.concat("base", "added")))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with each run of overlapping spans replaced by mark; spans: ordered by start."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        empty,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans found in them replaced by a mark.

    Spans are looked up by id and a hash of the text, so rows that share an id keep their own, and repeated rows have the same. A null or empty
    text stays as it is, very long ones are searched whole, an empty table stays empty; further columns stay, whatever their names, but
    for n_chars, which follows the text.
    """
    text_hash = F.xxhash64("text")
    pair, spans_, id_, hash_, own = fresh(docs, "pair", "spans", "span_id", "span_hash", "own_hash")
    found = find_secrets(docs.select(F.struct(F.col("doc_id"), text_hash.alias("hash")).alias(pair), "text"), doc_id=pair)
    spans = found.filter(F.size("spans") > 0).groupBy("doc_id").agg(F.first("spans").alias(spans_))
    spans = spans.select(F.col("doc_id.doc_id").alias(id_), F.col("doc_id.hash").alias(hash_), spans_)
    keyed = docs.withColumn(own, text_hash)
    out = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans[id_]) & (keyed[own] == spans[hash_]), "left")
    text = F.when(F.col(spans_).isNotNull(), redacted(F.col("text"), F.col(spans_))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_linked")
    )


QUERIES = {"op10_linked_secrets": op10_linked_secrets}
