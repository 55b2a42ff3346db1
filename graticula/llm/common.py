"""What the operators share: where intermediate tables go, and small column helpers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The white space of all word rules here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may leave it unset: it gets one of its own then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = kept(f"folder of {spark.sparkContext.applicationId}", lambda: tempfile.mkdtemp(prefix="graticula-"))
    return folder.rstrip("/")


def kept(name: str, make: Callable[[], T]) -> T:
    """What make gives, made once in this process.

    Functions travel to the workers by value, and their globals with them, so those last for one task only; a module lasts.
    """
    state = sys.modules.setdefault("graticula_process_state", types.ModuleType("graticula_process_state")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage, and lost executors do not lose it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of text as an array; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_SPLIT, -1)).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many trailing underscores as it takes not to clash with the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
