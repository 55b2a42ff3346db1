"""A corpus pipeline of five stages, each an operator of graticula.llm, over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graticula.llm import decontaminate, packing, quality, secrets, simhash
from graticula.llm.common import shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("packing", packing.stage),
]

#: SQL has neither the fingerprints nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
