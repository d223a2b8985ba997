"""Shared pieces of the corpus operators: the shared folder, cut lineage, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import ship

__all__ = ["WordHash", "crc_mod", "dropped", "grams", "lean", "mixed", "odd", "shared_dir", "ship", "table", "written"]

_OWN_DIR: list[str] = []
#: While a table is written: shuffle files go as soon as the query ends, Python workers get small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this process only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="parchment-"))
    return _OWN_DIR[0]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The shuffle files of the writing query are removed as soon as it ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/parchment/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/parchment/" in x}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives freed memory back to the system when its task ends: workers are used again and again, by turns."""

    def all_of(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return all_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, mod `mod`; ids that are null count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembering a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(w: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = odd(seed, k)
    out = w[:n] * m[0]
    for j in range(1, k):
        out += w[j : j + n] * m[j]
    return mixed(out)
