"""Blocked Bloom filters of 64-bit values as numpy arrays: of at most MOST_BITS, whatever the input, so a filter can go to every task. An exact step follows each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.words import mix

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bits_for(n: int) -> int:
    """16 to 32 bits a value, so that about one other value in 500 passes, up to MOST_BITS (32 MB); beyond, more pass."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length() if n else 0))


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value's 64-bit block and its three bits there."""
    h = mix(values.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    one, low = np.uint64(1), np.uint64(63)
    return (h % np.uint64(bits // 64)).astype(np.int64), one << (h >> np.uint64(40) & low) | one << (h >> np.uint64(50) & low) | one << (h >> np.uint64(58))


def masks(values: np.ndarray, bits: int) -> pa.Table:
    """Rows (block, mask) of some values, one per block."""
    block, mask = _places(values, bits)
    order = np.argsort(block, kind="stable")
    block, mask = block[order], mask[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    held = np.bitwise_or.reduceat(mask, first) if len(first) else mask
    return pa.table({"block": pa.array(block[first], pa.int64()), "mask": pa.array(held.view(np.int64), pa.int64())})


def gathered(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter from rows (block, mask): bits / 64 words at most reach the driver."""
    held = rows.groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[held.column("block").to_numpy()] = held.column("mask").to_numpy().view(np.uint64)
    return words


def of_column(rows: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column, of a size that follows the number of rows."""
    rows = rows.where(F.col(column).isNotNull()).select(column)
    bits = bits_for(rows.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from masks(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits).to_batches()

    return gathered(rows.mapInArrow(run, "block long, mask long"), bits)


def maybe(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False where a value is surely not in the filter."""
    block, mask = _places(values, len(words) * 64)
    return words[block] & mask == mask
