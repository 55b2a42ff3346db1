"""The pipeline's stages one after the other, on small tables."""

from __future__ import annotations

import collections

import corpus_pipeline


def test_stages(spark, tmp_path):
    prose = "The river runs past the old mill and down to the sea. Nobody knows how long the mill has stood there, or who built it. "
    item = "which of these four rivers is the longest one that runs wholly inside a single country today"
    rows = [
        (0, prose + "It is quiet.", "en", "a", 1),
        (1, prose + "It is quiet.", "en", "a", 1),
        (2, "Home | News | Mail | Shop | Help | More | Less | All | None | Some", "en", "b", 1),
        (3, f"A page of questions follows here, as found on the net. {item}. That was it.", "en", "b", 1),
        (4, 'Some notes on how to log in, kept by the staff of the place. token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" is it.', "en", "b", 1),
        (5, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted({r.doc_id for r in docs.collect()}))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 3:
            assert "[REDACTED]" in next(r.text for r in docs.collect() if r.doc_id == 4)
    assert kept == [[0, 1, 3, 4], [0, 3, 4], [0, 4], [0, 4], [0, 4]]
    whole = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        whole[r.doc_id] += r.length
    assert set(whole) == {0, 4}
