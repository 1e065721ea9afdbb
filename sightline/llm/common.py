"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (a test) may leave that unset and gets a folder under its warehouse; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, and the path, for callers that can tell when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    STORED[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Stored tables that results may still be read from. They go when the driver's program ends.
STORED: dict[str, SparkSession] = {}


@atexit.register
def forget_all() -> None:
    for path, spark in list(STORED.items()):
        with contextlib.suppress(Exception):  # the JVM may have gone before
            forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    STORED.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What empties the memory that an operator keeps in a worker from one task to the next, by operator.
MEMORIES: dict[str, Callable[[], None]] = {}


def drop_memories() -> None:
    """At the start of a task that needs no such memory: Spark reuses workers, and what an earlier stage's tasks keep would
    add to what this one's need."""
    for empty in MEMORIES.values():
        empty()


def release_memory() -> None:
    """Give back to the system what earlier stages' tasks freed: Arrow's pool and the C library's heap keep it in a worker.
    Without a C library that can do so, the heap stays as it is."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of an Arrow batch, about, so that rows with long texts don't fill a worker's memory.
BATCH = 8 << 20


def batch_bytes(spark: SparkSession) -> int:
    """Bytes of an Arrow batch in this session, set or by default."""
    return spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH bytes, unless it is lower already. It stays so, as plans read
    it when they run: a setting of the session, which every operator here needs."""
    if not 0 < batch_bytes(spark) <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, null text read as empty, so that further columns can't clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(mod: int, rest: int):
    """Column: crc32 of the id as text leaves the remainder kept for measuring."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample_labelled(docs: DataFrame, labels: DataFrame, target: str, mod: int, rest: int, per_class: int) -> tuple[DataFrame, str]:
    """``doc_id, y, h, text`` of at most ``per_class`` training rows of each label, chosen by a hash ``h`` of the id over
    all labelled ids that have a document; stored, and the path to forget it by.

    Held-out documents and null labels never enter. Of repeated ids one label (the larger) and one text (the smallest)
    stay, so there is one row for each id. Ids are picked before any text is touched; at most ``2 * per_class`` of them
    are broadcast.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
         .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out(mod, rest))
         .groupBy("doc_id").agg(F.max("y").alias("y")).join(ids, "doc_id", "left_semi"))
    picked = None
    for v in (0, 1):
        part = y.where(F.col("y") == v).select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    return stored_at(rows, "sample")


def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.to_pandas()


def as_batch(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    """One Arrow batch from lists or arrays, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of ``column``, at least one row each."""
    sizes = batch.column(column).nbytes
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(sizes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


#: Bytes that separate words: space and 0x09 to 0x0D.
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(column: pa.Array, block: int = 4 << 20) -> np.ndarray:
    """Words, maximal runs of bytes other than GAP, of each value of a binary column without nulls; ``block`` bytes at once."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, edges, data = column.buffers()
    n = len(column)
    out = np.zeros(n, dtype=np.int64)
    if not n or data is None:
        return out
    edges = np.frombuffer(edges, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    for at in range(int(edges[0]), int(edges[-1]), block):
        end = min(at + block, int(edges[-1]))
        gap = GAP[data[at:end]]
        before = np.empty_like(gap)
        before[1:] = gap[:-1]
        before[0] = at == edges[0] or GAP[data[at - 1]]
        starts = edges[np.searchsorted(edges, at) : np.searchsorted(edges, end)] - at  # where a value begins, a word may
        before[starts] = True
        place = np.flatnonzero(before & ~gap) + at
        out += np.bincount(np.searchsorted(edges, place, side="right") - 1, minlength=n)
    return out
