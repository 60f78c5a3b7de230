"""Substring search by an index of trigrams: which rows hold three characters in a row, as bitmaps of row ids, so that a search reads the postings of its term and verifies only rows that hold all of its trigrams.

The index is a table (part, trigram, block, ids): ids is a bitmap of the ids of a block of 32,768. Rows need an id that is a whole number; ids that lie close together make
small indexes. A search opens the parts of its trigrams alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators.catalog import contains_any


#: Characters of texts that are looked at at once, and places that a task holds before it lists them.
SLICE, HELD = 1 << 18, 1 << 21


def _part(trigram: Column, parts: int) -> Column:
    return (F.crc32(trigram) % parts).cast("int")


def _coded(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts that stand one behind the other, 21 bits a character, and the numbers of their texts."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(of[:-2] == of[2:]) if len(c) > 2 else np.zeros(0, np.int64)
    return c[inside] | c[inside + 1] << 21 | c[inside + 2] << 42, of[inside]


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of block, place and texts: the different trigrams of each row with its block and place, by slices of SLICE characters, a longer row alone."""
    for batch in batches:
        texts = [pc.fill_null(c, "") for c in batch.columns[2:]]
        ends = np.cumsum(sum(pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            parts = [t.slice(lo, hi - lo) for t in texts]
            coded = [_coded("".join(t.to_pylist()), pc.utf8_length(t).to_numpy(zero_copy_only=False)) for t in parts]
            codes = pa.array(np.concatenate([c for c, _ in coded])).dictionary_encode()
            each = np.unique(codes.indices.to_numpy().astype(np.int64) * (hi - lo) + np.concatenate([of for _, of in coded]))
            code, of = codes.dictionary.to_numpy()[each // (hi - lo)], each % (hi - lo) + lo
            yield code, batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of]
            lo = hi


def _partial_postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, block, places (two bytes each), merged whenever HELD of them have come together."""
    held, n = [], 0

    def merged() -> pa.RecordBatch:
        code, block, place = (np.concatenate(x) for x in zip(*held, strict=True))
        codes, blocks = (pa.array(x).dictionary_encode() for x in (code, block))
        pair = codes.indices.to_numpy().astype(np.int64) * len(blocks.dictionary) + blocks.indices.to_numpy()
        each = np.sort(pair << 15 | place)
        pair, place = each >> 15, each & 0x7FFF
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        c, block = codes.dictionary.to_numpy()[pair[first] // len(blocks.dictionary)], blocks.dictionary.to_numpy()[pair[first] % len(blocks.dictionary)]
        grams = np.stack([c & 0x1FFFFF, c >> 21 & 0x1FFFFF, c >> 42], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
        edges = pa.py_buffer(np.r_[first * 2, len(place) * 2].astype(np.int32))
        places = pa.Array.from_buffers(pa.binary(), len(first), [None, edges, pa.py_buffer(place.astype("<u2"))])
        return pa.RecordBatch.from_arrays([pa.array([grams[i : i + 3] for i in range(0, len(grams), 3)]), pa.array(block), places], names=["trigram", "block", "places"])

    for found in _sets(batches):
        held.append(found)
        n += len(found[0])
        if n >= HELD:
            yield merged()
            held, n = [], 0
    if n:
        yield merged()


def _bitmap(places: Column) -> Column:
    """The bitmap of 32,768 bits of a text of places."""

    @F.pandas_udf("binary")
    def drawn(held: pd.Series) -> pd.Series:
        def one(x: bytes) -> bytes:
            bits = np.zeros(4096, np.uint8)
            at = np.frombuffer(x, "<u2")
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            return bits.tobytes()

        return held.map(one)

    return drawn(places)


def write_index(rows: DataFrame, key: str, columns: Sequence[str], path: str, parts: int = 64) -> None:
    """Writes the index of some text columns; parts: folders that trigrams are dealt to. Trigrams never reach over the end of a column. Rows without a key are left out.

    Each task lists its rows by trigram in slices of bounded size; only the lists move, once, two bytes for each row and trigram.
    """
    ids = rows.where(F.col(key).isNotNull()).withColumn("_id", F.col(key).cast("long"))
    texts = ids.select(F.bitmap_bucket_number("_id").alias("block"), F.bitmap_bit_position("_id").alias("place"), *(F.lower(F.col(c)).alias(f"text{i}") for i, c in enumerate(columns)))
    lists = texts.mapInArrow(_partial_postings, "trigram string, block long, places binary").withColumn("part", _part(F.col("trigram"), parts))
    postings = lists.repartition("part").groupBy("part", "trigram", "block").agg(F.listagg("places").alias("places"))
    dealt = postings.select("trigram", "block", _bitmap(F.col("places")).alias("ids"), "part")
    dealt.sortWithinPartitions("part", "trigram", "block").write.partitionBy("part").parquet(path)


def needed(spark: SparkSession, term: str) -> list[str]:
    """The trigrams that every text which matches a term holds: those of its stretches between wildcards, in lower case as Spark has it."""
    low = spark.range(1).select(F.lower(F.lit(term)).alias("t")).first().t
    stretches = re.split(r"\\.|[%_\\]", low, flags=re.S)
    return sorted({s[i : i + 3] for s in stretches for i in range(len(s) - 2)})


def postings(spark: SparkSession, path: str, grams: Sequence[str], parts: int = 64) -> DataFrame:
    """Postings of some trigrams; only their parts are read."""
    where = sorted({zlib.crc32(g.encode()) % parts for g in grams})
    return spark.read.parquet(path).where(F.col("part").isin(*where) & F.col("trigram").isin(*grams))


def candidates(spark: SparkSession, path: str, grams: Sequence[str], parts: int = 64) -> DataFrame:
    """id: rows that hold all of some trigrams."""
    blocks = postings(spark, path, grams, parts).groupBy("block").agg(F.count("*").alias("n"), F.bitmap_and_agg("ids").alias("ids")).where(F.col("n") == len(grams))
    byte, bit = F.sequence(F.lit(0), F.lit(4095)), F.sequence(F.lit(0), F.lit(7))
    held = blocks.where(F.bitmap_count("ids") > 0).select("block", F.col("ids"), F.explode(byte).alias("byte"))
    value = F.conv(F.hex(F.substring(F.col("ids"), F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
    bits = held.withColumn("value", value).where("value > 0").select("block", "byte", "value", F.explode(bit).alias("bit")).where(F.expr("(value >> bit) & 1 = 1"))
    place = F.col("byte") * 8 + F.col("bit")
    return bits.select(F.when(F.col("block") > 0, (F.col("block") - 1) * 32768 + place + 1).otherwise(F.col("block") * 32768 - place).alias("id"))


def search(rows: DataFrame, key: str, columns: Sequence[str], term: str, path: str, parts: int = 64) -> DataFrame:
    """The rows any of whose columns contains a term, without regard to case; `%` and `_` in the term act as wildcards. Equal to a scan with contains_any, which terms without three characters in a row still need, and rows without a key always."""
    grams = needed(rows.sparkSession, term)
    verified = contains_any(columns, term)
    if not grams:
        return rows.where(verified)
    ids = candidates(rows.sparkSession, path, grams, parts).withColumnRenamed("id", "_id")
    found = rows.join(ids, F.col(key).cast("long") == F.col("_id"), "left_semi").where(verified)
    return found.unionByName(rows.where(F.col(key).isNull() & verified))
