"""Token counts by a count-only Viterbi.

A unigram model's best segmentation of a text is counted without building it. An Aho-Corasick automaton over the vocabulary gives all pieces
that end at each character, longest first; dynamic programming carries the best score, the number of pieces and whether the last
one is unknown. Ties are the tokenizer's own: a candidate replaces another only if its score is strictly larger, and candidates come in the
order of where they begin, so the longest piece wins. A character that is no piece costs the lowest score less 10, and
neighbouring unknown characters are one piece.

Texts are cut as by a metaspace pre-tokenizer: each blank becomes U+2581 and begins a new word, and the text's first word gets one too. Words
repeat, so each worker keeps the counts of short ones, a bounded number of them.

Defined cases: a null text counts as empty and has no piece; repeated rows are counted each by itself; an empty table gives an empty result;
further columns do not take part; very long words are counted in one pass with a few numbers for each character.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.common import kept

META = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 200_000
CACHED_LENGTH = 32


def ranked_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file, in order, with Zipf log-probabilities by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = log(sum(1 / k for k in range(1, len(plain) + 1)))
    return [(p, -log(k) - norm) for k, p in enumerate(plain, 1)]


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        n = len(word)
        best, count, last_unknown, single = [-inf] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        at = 0

        def close(upto: int) -> None:
            # ends up to `upto` have all their pieces: the unknown character is the last candidate of each
            nonlocal at
            while at < upto:
                at += 1
                if not single[at]:
                    score = self.unknown + best[at - 1]
                    if best[at] == -inf or score > best[at]:
                        best[at], count[at], last_unknown[at] = score, count[at - 1] + (not last_unknown[at - 1]), True

        for end, (length, score) in self.automaton.iter(word):
            end += 1
            if end > at + 1:
                close(end - 1)
            start = end - length
            total = score + best[start]
            if best[end] == -inf or total > best[end]:
                best[end], count[end], last_unknown[end] = total, count[start] + 1, False
            if length == 1:
                single[end] = True
        close(n)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text."""
        parts = text.replace(META, " ").split(" ")
        if not text:
            return 0, 0.0
        if parts[0] == "":
            parts = parts[1:]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, pieces, score = self.known, 0, 0.0
        for p in parts:
            found = known.get(p)
            if found is None:
                found = self.word(META + p)
                if len(p) <= CACHED_LENGTH:
                    known[p] = found
            pieces += found[0]
            score += found[1]
        return pieces, score


def counter(path: str) -> PieceCounter:
    """One for each process and file."""
    return kept(f"pieces of {path}", lambda: PieceCounter(ranked_vocabulary(path)))


def piece_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pieces and score (log-probability of the best segmentation) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for pdf in batches:
            found = [c.text(t or "") for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pieces": [n for n, _ in found], "score": [s for _, s in found]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(run, f"doc_id {kind}, pieces long, score double")


def op2_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("score", F.round("score", 4))


QUERIES = {"op2_viterbi_counts": op2_viterbi_counts}
