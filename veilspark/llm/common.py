"""What the training-data operators share: the shared folder, sized joins, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import veilspark

# Tasks carry the package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(veilspark)

#: Rows of a table that may be broadcast; above it a join is left to shuffles.
BROADCAST_ROWS = 200_000
#: UTF-8 bytes of text that a worker holds at once, unless one text is longer.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local sessions that set none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        found = tempfile.mkdtemp(prefix="veilspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage in the shared folder; Spark's cleaner owns the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package has written, in whichever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all of them in the column `row`, so that working columns can't clash with the others."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles of what is settled and no longer held, which it learns of only by a collection."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns to the system what this process has dropped, objects in cycles and Arrow's unused blocks, too."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, for workers that Spark keeps for other tasks and stages: gives memory back before a task begins and when it has ended."""

    def run(batches):
        give_back()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def join_sized(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts the settled table `right` only if its counted rows are within the bound; else AQE deals the join, splitting hot keys."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= bound else right, on, how)


def texts(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `most` bytes, so that a run of long texts doesn't fill a worker."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            held += int(n)
            if held >= most:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those of the smallest hash of the key: the same at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(rows)


#: Slots of a sketch that one row describes, as a power of two.
_CHUNK = 20


def slot_batches(slots: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, slots) that say which slots of a sketch were met, and which of them more than once."""
    found, times = np.unique(slots, return_counts=True)
    if not len(found):
        return
    chunk = found >> min(_CHUNK, bits)
    at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    blobs = []
    for a, b in zip(at, np.r_[at[1:], len(found)], strict=True):
        gaps = (np.diff(found[a:b], prepend=found[a] & ~((1 << min(_CHUNK, bits)) - 1)) * 2 + (times[a:b] > 1)).astype("<u4")
        blobs.append(zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(chunk[at], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "slots"])


def marked_twice(rows: DataFrame, bits: int):
    """A broadcast bit for each slot that was met more than once; 2 ** bits of them, whatever the input."""
    width = min(_CHUNK, bits)

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for c, blob in zip(b.column("chunk").to_pylist(), b.column("slots"), strict=True):
                gaps = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                at, twice = np.cumsum(gaps >> 1, dtype=np.int64), (gaps & 1).astype(np.uint8)
                times = seen.setdefault(c, np.zeros(1 << width, np.uint8))
                times[at] = np.minimum(times[at] + 1 + twice, 2)
        for c, times in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(times > 1, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    size = max(1, (1 << width) // 8)
    for r in rows.repartition(max(1, min(64, 1 << (bits - width))), "chunk").mapInArrow(run, "chunk int, bits binary").collect():  # the sketch, of fixed size
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


class Memo(dict):
    """A dict that computes missing values; of two generations of bounded size, the older goes when the younger is full.

    Strings over `longest` are computed each time, so the bytes held are bounded, too.
    """

    def __init__(self, fn: Callable, most: int, longest: int = 128):
        super().__init__()
        self.fn, self.most, self.longest, self.old = fn, max(1, most // 2), longest, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.longest:
            return self.fn(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key, self)
        self[key] = value = self.fn(key) if value is self else value
        return value
