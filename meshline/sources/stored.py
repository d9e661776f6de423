"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set and all runs on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = folder.root = getattr(folder, "root", None) or tempfile.mkdtemp(prefix="meshline-")
    return root.rstrip("/")


def dealt(df: DataFrame, rows: int, *key: str, each: int = 100_000) -> DataFrame:
    """``df`` dealt by ``key`` (without one in turn) to a task for ``each`` of the ``rows`` that it comes from.

    Spark sizes tasks by bytes read, so few bytes that make much work come together in a few of them; these stay apart, and
    what a task holds doesn't grow with the input. Windows, groups and joins whose keys contain ``key`` need no exchange more.
    """
    return df.repartition(max(1, -(-rows // each)), *key)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
