"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Only a local session, where both are one machine, gets a temporary folder if that is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    return path


def _file(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def made_folder(spark: SparkSession, path: str) -> None:
    """Make a folder, which stays empty if nothing is written into it."""
    fs, p = _file(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back; with its path, to delete it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for a table that stays until the driver ends."""
    return stored(df, name)[0]


#: Seconds between two collections of the driver's garbage while a long job runs.
COLLECT_S = 5.0


@contextmanager
def garbage_collected(spark: SparkSession) -> Iterator[None]:
    """While the block runs, and once when it ends, the driver's JVM collects its garbage.

    Spark deletes a shuffle's files once nothing on the driver refers to it and the JVM has noticed, which a driver with
    memory to spare may not do for half an hour. ``spark.cleaner.periodicGC.interval`` does the same for a whole session,
    but can't be set in one that runs.
    """
    ended = threading.Event()

    def collect() -> None:
        while not ended.wait(COLLECT_S):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        spark.sparkContext._jvm.System.gc()


#: Rows of a table that may be broadcast, and parts that a group's rows are dealt to if it has more.
BROADCAST_ROWS, PARTS = 50_000, 64


def attach(df: DataFrame, groups: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join a written table of one row per group to the groups' rows; null is a value of a key.

    The groups are counted: few are broadcast, so that no row of ``df`` moves, and many are copied to PARTS parts, so
    that a group with a third of all rows is dealt to as many tasks.
    """
    right = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    if groups.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), on, how).drop(*(f"__{k}" for k in keys))
    right = right.withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    df = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS).cast("long")))
    return df.join(right, on & (F.col("__part") == F.col("__to")), how).drop("__part", "__to", *(f"__{k}" for k in keys))


def row_key(doc_id: Column, text: Column) -> Column:
    """One long for a row's id and whole text; repeated rows share it. Null id and null text are told apart from values."""
    return F.xxhash64(doc_id, F.isnull(doc_id), text, F.isnull(text))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast("large_binary").to_pylist()]


def by_bytes(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of at most ``limit`` total length, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """Word to 64-bit hash, remembered for up to ``keep`` words."""

    def __init__(self, strip: bytes = b"", keep: int = 1 << 20):
        self.strip, self.keep = strip, keep

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(self.strip) if self.strip else word
        value = xxhash.xxh3_64_intdigest(bare) if bare else 0
        if len(self) >= self.keep:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes with A-Z lower-cased; bytes.split() cuts at space, tab, LF, VT, FF and CR only."""
    return text.lower().split()


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def concat(arrays: Iterable[np.ndarray], dtype) -> np.ndarray:
    arrays = list(arrays)
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)
