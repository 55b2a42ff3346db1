"""Quality rules: line-first cleaning.

Every line is judged by punctuation, navigation, symbol and boilerplate rules; failing lines go, and a document that loses too
much of its text with them is rejected. All of it is built-in column expressions over one scan: no shuffle, no Python.

Defined cases: a null text counts as empty and has no words, so the base rule rejects it; blank lines are neutral and stay; repeated
rows are judged alike, each by itself; an empty table gives an empty result; further columns pass through `clean_lines` untouched,
and its own columns get trailing underscores where their names are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.common import fresh, words

#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "skip to content",
    "back to top",
)
SYMBOLS = r"[#*$%&|<>]"
MARKS = ".!?…"
WINDOW = 5


def line_passes(line: Column, max_tail_words: int = 10, max_symbols: float = 0.05, max_shouts: int = 3) -> Column:
    """True for a line of prose.

    It fails if no sentence mark ends a word in it, or more than max_tail_words follow the last one (punctuation); if it has two
    or more bars (navigation); if more than max_symbols of its characters are symbols, or it has max_shouts or more double
    exclamation marks (noise); or if it holds a phrase of BOILERPLATE.
    """
    end = F.right(F.rtrim(line), F.lit(1))
    punctuated = end.isin(*MARKS) | line.rlike(rf"[{MARKS}][\"'”’»)\]]*(?:\s+\S+){{0,{max_tail_words}}}\s*$")
    noisy = line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) > F.length(line) * max_symbols)
    navigation = line.rlike(r"\|[^|]*\|")
    shouting = F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit("!!")) >= max_shouts)
    boilerplate = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return punctuated & ~navigation & ~noisy & ~shouting & ~boilerplate


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __words, and the base figures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words compares windows by 64-bit hashes; only texts in which one occurs twice have their windows sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", words(t)).withColumn("__hashed", F.transform("__words", lambda w: F.xxhash64(w)))
    starts = F.slice("__hashed", 1, F.greatest(F.size("__hashed") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("__grams", F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get("__hashed", i + k) for k in range(1, WINDOW)))))
    repeated = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = df.withColumn("__sorted", F.when(repeated, F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("__sorted", i - 1)["h"]) | (x["h"] == F.get("__sorted", i + 1)["h"])
    marked = F.transform("__sorted", lambda x, i: F.when(F.coalesce(same(x, i), F.lit(False)), x["i"]))
    df = df.withColumn("__at", F.sort_array(F.filter(marked, lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.least(F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__worded": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumn("n_dup_lines", (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    return df.drop("__hashed", "__grams", "__sorted", "__at", "__words")


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = 0.6, **rules) -> DataFrame:
    """df with the cleaned text and the verdict.

    New columns: clean_text (the text without failing lines), lost_share (of the characters in lines with a word), the base
    figures, and kept: the base rule holds and at most max_lost of the text was lost.
    """
    clean, lost, *own = fresh(df, "clean_text", "lost_share", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    held = {c: f"__own{i}" for i, c in enumerate(df.columns)}
    out = measured(df.select(*(F.col(f"`{c}`").alias(h) for c, h in held.items())), held[text])
    t = F.coalesce(F.col(held[text]), F.lit(""))
    out = out.withColumn("__good", F.filter(F.split(t, "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x, **rules)))
    out = out.withColumn("__clean", F.array_join("__good", "\n"))
    # only lines with words are lost, so the difference of lengths, less the line ends, is what was lost
    gone = F.length(t) - F.length("__clean")
    out = out.withColumn("__lost", F.when(F.length(t) > 0, gone / F.length(t)).otherwise(F.lit(0.0)))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(
        *(F.col(h).alias(c) for c, h in held.items()),
        F.col("__clean").alias(clean),
        F.col("__lost").alias(lost),
        *(F.col(c).alias(o) for c, o in zip(figures, own, strict=False)),
        # the row number, always at least 0, keeps filters on the verdict above this projection: pushed below, they would be
        # computed again, with all that they rest on
        (~F.col("base_failed") & (F.col("__lost") <= max_lost) & (F.monotonically_increasing_id() >= 0)).alias(own[-1]),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with the cleaned text and its length.

    Null, empty and short texts fail; repeated rows pass or fail together; very long texts are read whole; an empty table stays empty;
    further columns stay, whatever their names, but for n_chars, which follows the text.
    """
    flagged = clean_lines(docs.select(*docs.columns))
    new = [c for c in flagged.columns if c not in docs.columns]
    kept, clean = new[-1], new[0]
    out = flagged.filter(F.col(kept)).withColumn("text", F.col(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share")
    )


QUERIES = {"op7_line_cleaning": op7_line_cleaning}
ORACLES = {
    "op7_line_cleaning": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT r, unnest(range(len(ws) - 4)) AS i, unnest(list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS gram FROM w WHERE len(ws) >= 5
), c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c.n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
judged AS (
  SELECT r, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
    (right(rtrim(line), 1) IN ('.', '!', '?', '…') OR regexp_matches(line, '[.!?…]["''”’»)\]]*(?:\s+\S+){0,10}\s*$'))
    AND NOT regexp_matches(line, '\|[^|]*\|') AND len(regexp_extract_all(line, '[#*$%&|<>]')) <= length(line) * 0.05 AND len(regexp_extract_all(line, '!!')) < 3
    AND NOT regexp_matches(line, '(?i)all rights reserved|licensed under|released under the|terms of use|terms of service|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|skip to content|back to top') AS passes
  FROM l
), lines AS (
  SELECT r, count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS dup,
    coalesce(sum(length(line) + 1) FILTER (NOT worded OR passes), 1) - 1 AS clean FROM judged GROUP BY r
), x AS (
  SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    lines.dup::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    CASE WHEN length(w.t) > 0 THEN (length(w.t) - lines.clean) / length(w.t)::DOUBLE ELSE 0.0 END::DOUBLE AS lost
  FROM w JOIN lines ON lines.r = w.r LEFT JOIN repeated ON repeated.r = w.r
), b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.6 AS kept, round(lost, 6) AS lost_share FROM b
""",
}
