"""What both vector searches share: usable vectors, bounded samples, lists with salts, and blocks met by query chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most (about: salts deal by hash), and queries of a chunk.
BLOCK_ROWS, CHUNK_QUERIES = 4096, 16384


def usable(rows: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of rows with an id and a finite vector; vectors of another than the most frequent length are left out."""
    v = F.col("v")
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & finite)
    if not allow_zero:
        good = good.where(F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (common[0]["d"] if common else 0))


def sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows whose ids hash lowest: a bounded, repeatable sample."""
    got = rows.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(n).collect()
    return np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got])


def matrix(column: pa.ChunkedArray | pa.Array, kind: str = "f8") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(n, len(values) // n if n else 0)


def assigned(rows: DataFrame, nearest: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with the number of each vector's list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(nearest(matrix(part.column("v"))), pa.int32())], names=["vec_id", "v", "list"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int")


def salts(lists: DataFrame, block_rows: int = BLOCK_ROWS) -> dict[int, int]:
    """Into how many blocks each list is dealt, so that no block outgrows a task. As many entries as lists, which are bounded."""
    return {r["list"]: -(-r["count"] // block_rows) for r in lists.groupBy("list").count().collect()}


def salt_of(per_list: dict[int, int]) -> Column:
    n = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(per_list.items()) for x in kv)), F.col("list")) if per_list else F.lit(1)
    return F.pmod(F.xxhash64("vec_id"), n.cast("long")).cast("int")


def chunks_of(n_queries: int) -> int:
    return max(1, -(-n_queries // CHUNK_QUERIES))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best per query, highest score first, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_rows(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best (score high, id low) per query number q."""
    order = np.lexsort((ids, -score, q))
    held = q[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    place = np.arange(len(held)) - np.repeat(first, np.diff(np.r_[first, len(held)]))
    return order[place < k]
