"""Shared plumbing of the training-data operators: tables, shared storage, Arrow batches and word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D]; the same six bytes at which bytes.split() splits.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a folder of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends there and a lost executor loses nothing. `files`: how many, where rows are few
    for the partitions that make them; every file costs a file system several calls."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Deletes what written() has left in the shared folder for this process; to be called when no DataFrame that reads it is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def files_for(rows: int, each: int = 250_000) -> int:
    return max(1, -(-rows // each))


#: Rows of an Arrow batch in place of Spark's default of 10,000: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = "1000"


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone, and keeps Arrow batches small unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def give_back() -> None:
    """Hands memory that nothing uses back to the system. Python workers outlive their tasks, and what Arrow and the allocator keep of one stage counts against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another allocator
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, then give_back()."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def map_rows(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, most_bytes: int = 4 << 20) -> DataFrame:
    """fn gets the columns of df as lists, for some rows at a time, and returns columns; runs are cut at most_bytes of Arrow data, so a batch of very long texts stays small."""
    ensure_importable(df.sparkSession)
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in regrouped(batches, most_bytes):
            out = fn(*(c.to_pylist() for c in rows.columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(tidy(run), schema)


def regrouped(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """The rows in runs of about most_bytes: small batches together, large ones in parts."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, most_bytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def ascii_lower(col: Column) -> Column:
    """A-Z only; lower() does the same where all is ASCII, and much faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of [^\\x20\\x09-\\x0D], as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(data: bytes) -> bytes:
    """bytes.lower() changes A-Z alone."""
    return data.lower()


class WordHashes(dict):
    """64-bit hash of each word. A memo of at most `most` words; what falls out is hashed anew, with the same result."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of `size` words, sorted; with fewer words the whole sequence is one, without words there are none."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - width + 1 + i])
    return np.unique(h)
