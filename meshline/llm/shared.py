"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Texts are handed to the vectorised steps in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 4_000_000
#: Parquet's setting for reading ranges side by side.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none (local tests), a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(shared_dir, "root", None) or tempfile.mkdtemp(prefix="meshline-")
        shared_dir.root = root
    return f"{root.rstrip('/')}/meshline-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Zstandard takes less of the folder than the default, and no direct buffers that only a collection frees.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 4_000_000) -> None:
    """Bound what goes to a Python worker at once by bytes; a session that has a lower bound keeps it.

    Nor are the ranges of a Parquet file read side by side, unless the session says so: each thread that does it keeps a
    direct buffer as large as the longest range it has read.
    """
    spark.conf.set(VECTORED, spark.conf.get(VECTORED, "false"))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("b")) > size:
        spark.conf.set(setting, size)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_order(keys: DataFrame, *order: str, rows_per_range: int = 100_000) -> DataFrame:
    """Add ``range_no`` to ``keys``: ranges in ascending order of ``order``, each of bounded size, stored.

    Windows can then run inside a range; only one row per range has to meet in a single task.
    """
    n = max(1, -(-keys.count() // rows_per_range))
    # nulls sort first here as in a window's ascending order
    dealt = keys.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]) if n > 1 else keys.coalesce(1)
    return materialize(dealt.withColumn("range_no", F.spark_partition_id()))


def remainder(column: str, m: int):
    """crc32 of the column's text mod ``m``; rows with a null key count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % m, F.lit(0))


def row_key(df: DataFrame):
    """A key of a row by its ``doc_id`` and ``text``: rows that share an id but not a text have keys of their own."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())


def give_back() -> None:
    """Return this worker's freed memory to the system: workers outlive their tasks, and both allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", size: int = SLICE_BYTES):
    """Cut a batch so that each part has about ``size`` bytes of text, at least one row."""
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(np.asarray(lens, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split texts at ASCII white space: distinct words, a code for each word, and each text's bounds in the codes.

    A blank at a text's start or end makes one empty word there.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(split.offsets, dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int32), bounds - bounds[0]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``coded_words``, with the distinct words as a list."""
    words, codes, bounds = coded_words(texts)
    return words.to_pylist(), codes, bounds
