"""What the training-data operators share: scratch tables, column carrying, word hashes."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes per Arrow batch: bounds on what a Python worker holds of long texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
BATCH_ROWS_KEY, BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffled bytes that a task of a written table should read.
PART_BYTES, PART_BYTES_KEY = 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where they are one process,
    may leave it unset and gets a temporary one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="hushlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to half its bound: Spark drops broadcasts and shuffles of
    finished plans when it is collected, and the heap shrinks to what is in use."""
    run = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if run.totalMemory() * 2 > run.maxMemory():
        run.gc()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, lost executors cost no recomputation, and the shuffle
    files that made it are dropped by Spark. Its tasks read small parts, so that their sorts need little memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushlake-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in (CLEAN_UP, PART_BYTES_KEY)}
    spark.conf.set(CLEAN_UP, "true")
    spark.conf.set(PART_BYTES_KEY, str(PART_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _tidy(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes; never raises a smaller setting. The settings are the
    session's, as Spark reads them when a plan runs."""
    for key, bound in ((BATCH_ROWS_KEY, BATCH_ROWS), (BATCH_BYTES_KEY, BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now > bound or now <= 0:
            spark.conf.set(key, str(bound))


#: What a Python worker keeps from one task to the next. Spark deals it the tasks of later stages too, whatever they run.
_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """make()'s value, kept by this worker until a tidied task comes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _trim() -> None:
    """Hand freed memory back to the machine: Arrow's pool and the C library hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, by a worker that drops what other tasks have it keep, and at the end hands back what is free: an
    executor's idle workers stay for a minute and count as its memory."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _kept.clear()
        yield from run(batches)
        _trim()

    return own


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add; Spark's names ignore case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def plus(df: DataFrame, extra: str) -> T.StructType:
    """df's schema with the columns of a DDL string behind it, all nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + T._parse_datatype_string(extra).fields)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null reads as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in col.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def appended(batch: pa.RecordBatch, extra: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """batch (less drop) with more columns behind it."""
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(extra.values()), names=names + list(extra))


class WordHash(dict):
    """word (bytes) -> 64-bit hash as a signed int, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h -= (h >> 63) << 64
        self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes, by doubling."""
    if len(h) < k:
        return h[:0]
    out, done, power, span, at = None, 0, h, 1, 0
    while True:
        if k & span:
            part = power[at : at + len(h) - k + 1]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            at += span
            done += span
        if done == k:
            return mix(out + np.uint64(k))
        n = len(power) - span
        power = mix(power[:n] * np.uint64(0xD6E8FEB86659FD93) + power[span : span + n])
        span *= 2


def binary_column(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
