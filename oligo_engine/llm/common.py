"""Helpers shared by the corpus operators: checkpoints, byte slabs, rolling hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that one numpy pass works on; a longer text makes a slab of its own.
SLAB_BYTES = 1 << 19
#: Rows of an Arrow batch: some MB of texts.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@cache
def _local_root(application: str) -> str:
    """One folder for each application; the setting itself cannot be changed at run time."""
    return tempfile.mkdtemp(prefix="corpus-checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; Spark deletes it once no plan refers to it
    (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder that go when the block ends: smaller than
    checkpoints where a step keeps millions of short rows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches that stay small where rows hold whole texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = texts_of(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], (offsets[first : last + 1] - offsets[first])
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes of any byte range modulo 2**64, over a random byte table.

    ``prefix(data)`` is one cumulative sum; ``span(prefix, start, end)`` hashes all the
    ranges at once, equal strings alike wherever they stand.
    """

    def __init__(self, seed: int):
        source = np.random.default_rng(seed)
        self.table = source.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(source.integers(1, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)

            def powers(base: int) -> np.ndarray:
                out = np.full(n, base, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.powers, self.backs = powers(self.base), powers(self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.backs[start])


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
