"""What the corpus operators share: tables, lineage cuts and word hashing."""

from __future__ import annotations

import importlib
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# what runs on executors goes there with its task, so that they need no copy of this package
cloudpickle.register_pickle_by_value(importlib.import_module(__package__))

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The words a worker remembers the hash of, before it starts anew.
CACHE_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where each table that ``cut`` wrote lies.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="quizlode-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: a lost executor recomputes nothing before this point."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quizlode/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, when all that they lead to has been written after them."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds the words of few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """64-bit hashes of words (bytes), the same on every worker; forgets everything when it grows past CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Iterable[bytes], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), so that all bits of a sum depend on all its terms."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, offsets: tuple[int, ...], seed: int) -> np.ndarray:
    """For every start, the hash of the words at ``offsets`` from it (in that order)."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for c, at in zip(odd_constants(len(offsets), seed), offsets, strict=True):
        total += words[at : at + n] * c
    return mix(total)
