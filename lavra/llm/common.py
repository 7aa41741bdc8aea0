"""Helpers shared by the training-data operators: reading tables, cutting lineage, word functions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts; every other character belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, narrowed to the columns named (all of them if none is)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is unset and
    all runs on one machine (tests), a new temporary folder that becomes it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    now = sc.getCheckpointDir()
    if not now and not sc.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not now:
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lavra-')}")
        now = sc.getCheckpointDir()
    return now.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever store Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lavra-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, a lost
    executor costs nothing that was written, and later plans see a plain scan."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what Python makes of a batch of long texts stays small."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > most_bytes:
                n //= 2
            yield b.slice(at, n)
            at += n


def give_back() -> None:
    """Hand freed memory back to the system. A worker process outlives its tasks, and what its allocators keep
    from one stage counts beside all that the executor needs in the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives its memory back at its end."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word, as an array<bigint>: what the Python stages receive instead of strings."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions for so many rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
