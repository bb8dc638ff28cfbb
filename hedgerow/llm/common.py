"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls 09-0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RX = r"[\x20\x09-\x0D]+"

#: Multiplier of the cheap random 64-bit mixes in numpy code.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RX))


def word_count(text: Column) -> Column:
    """Number of words, without keeping them: starts of runs of other characters than white space."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 is held out. A null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def unit(key: Column) -> Column:
    """A number in (0, 1) from md5 of a key: the same in every run, engine and partitioning."""
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hedgerow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hedgerow-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, lost executors cost nothing.

    The collection at the end lets Spark's context cleaner drop shuffle files that only the old lineage referred to.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    del df
    for _ in range(2):  # the first frees what Python held, the second what only that kept alive in the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """About the stored size of a table, for choosing a number of ranges: the optimizer's estimate where it has one
    (files), else half the bytes of the texts, counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind == "string"]
    return int(df.select(sum(texts, F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0) // 2


def runs_of(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a sequence into runs whose sizes sum to at most `most` (single larger items stand alone)."""
    start = total = 0
    k = -1
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if k >= start:
        yield start, k + 1


def trim() -> None:
    """Give memory that a task has freed back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
