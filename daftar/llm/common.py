"""Helpers the training-data operators share: shared storage, Arrow text slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text that one slice of an Arrow batch holds (one longer text is a slice of its own).
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session makes one of its own; on a cluster it must be set, as a folder of one machine would lose data."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="daftar-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/daftar-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables that no DataFrame will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's bound of an Arrow batch is lowered to BATCH_BYTES, as executors hold several batches of long texts beside their heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def with_own_names(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, prefix: str) -> DataFrame:
    """operator(docs), whose own columns have names with a prefix: columns of docs with such names go through it under others and come back as they were."""
    taken = {c.lower() for c in docs.columns}
    free = (f"kept{i}" for i in count() if f"kept{i}" not in taken)
    other = {c: next(free) for c in docs.columns if c.startswith(prefix)}
    if not other:
        return operator(docs)
    return operator(docs.withColumnsRenamed(other)).withColumnsRenamed({v: k for k, v in other.items()})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Gives memory that Arrow and the C library hold free back to the system: workers are used again, task after task, and stand beside the JVM in the executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def buckets_for(docs: DataFrame) -> int:
    """Into how many buckets what is gathered from docs is dealt: with the input's partitions, which are of bounded size, and no less than the shuffle's."""
    return max(partitions(docs.sparkSession), docs.rdd.getNumPartitions())


def arrow_type(kind: DataType) -> pa.DataType:
    return to_arrow_type(kind)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into row ranges of about `limit` text bytes: (rows, UTF-8 bytes of all their texts, offsets). Null counts as empty."""
    texts = pc.fill_null(batch.column(column), "")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    release()
