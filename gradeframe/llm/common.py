"""Scratch tables, row keys and vectorised word helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

# The separators of words: space, tab, \n, \v, \f, \r. These are also what
# ``bytes.split()`` splits at, so a word list is ``text.encode().split()``.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset it is a folder below the warehouse, which is shared as well.
    The path is removed when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    if _stage_paths is not None:
        _stage_paths.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What is read survives lost executors, has a known size (so Spark's own
    broadcast decision rests on it) and feeds joins straight from a scan, the
    form in which adaptive execution splits a hot key.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stage_paths: list[str] | None = None


@contextmanager
def noting_paths(paths: list[str]) -> Iterator[None]:
    """Note the scratch paths that are named within, so that they can be removed before the driver ends."""
    global _stage_paths
    before, _stage_paths = _stage_paths, paths
    try:
        yield
    finally:
        _stage_paths = before


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch`` named, before the driver ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def bucketed(df: DataFrame, keys: Sequence[str], name: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder, dealt out by keys, so that later joins on them do not move it again.

    There are as many buckets as shuffle partitions. The table's name lives only
    until the frame knows its files.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    # A task has the rows of one bucket: with writers kept open, they need not be sorted by bucket first.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        df.repartition(count, *keys).write.format("parquet").bucketBy(count, *keys) \
            .option("path", path or scratch(spark, name)).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.conf.set(writers, before)
        spark.sql(f"drop table if exists {table}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of each text; NULL is empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def chunked(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``; one at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, UTF-8 of the texts) of neighbours with about ``most`` bytes together; NULL is empty.

    Only one part at a time becomes Python objects.
    """
    raw = texts.cast(pa.binary())
    for start, end in chunked(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), most):
        yield start, end, [t or b"" for t in raw.slice(start, end - start).to_pylist()]


def trimmed() -> None:
    """Give freed memory back to the system; a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Start of each part, and the end of the last, when parts of these lengths are put in a row."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew in each part."""
    total = int(np.sum(counts))
    return np.arange(total, dtype=np.int64) - np.repeat(starts_of(counts)[:-1], counts)
