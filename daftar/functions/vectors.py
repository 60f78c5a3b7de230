"""Vector columns: inner product, cosine, its map to 0..1, normalisation, hashed embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.functions.text import words


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """-1 to 1; 0 for unlike lengths, nulls and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), inner(a, b) / n).otherwise(0.0)


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 inside 0..1; 0 for unlike lengths and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (inner(a, b) / n + 1) / 2))).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _first(ws: Column, n: int | None) -> Column:
    """The first n words; all of them for None."""
    return ws if n is None else F.slice(ws, 1, n)


def hashed_embedding(c: Column, dim: int = 256, most_words: int | None = 1000) -> Column:
    """A bag of hashed words: the i-th word (from 0) adds 1/(i+1) to three slots; unit length; zeros for blank text."""
    ws = _first(words(F.lower(c)), most_words)
    slots = F.flatten(F.transform(ws, lambda w, i: F.array(*(F.struct(F.pmod(F.xxhash64(w, F.lit(k)), F.lit(dim)).cast("int").alias("slot"), (F.lit(1.0) / (i + 1)).alias("weight")) for k in range(3)))))
    # Arrays of one hold the slots, the sums and the length, so that each is computed once.
    raw = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(held, lambda s: s["slot"] == d), F.lit(0.0), lambda acc, s: acc + s["weight"]))
    both = F.transform(F.transform(F.array(slots), raw), lambda r: F.struct(r.alias("raw"), norm(r).alias("n")))[0]
    unit = lambda b: F.when(b["n"] > 0, F.transform(b["raw"], lambda x: x / b["n"]))
    return F.coalesce(F.transform(F.array(both), unit)[0], F.array_repeat(F.lit(0.0), dim))


def hashed_embeddings(rows: DataFrame, key: str, text: str, dim: int = 256, most_words: int | None = 1000) -> DataFrame:
    """(key, embedding) as hashed_embedding makes it, for whole tables: all of a text stands in its row, so its slots are summed there, batch by batch, and nothing moves."""
    ws = rows.select(F.col(key), F.coalesce(_first(words(F.lower(text)), most_words), F.array().cast("array<string>")).alias("_words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            sizes = held.value_lengths().to_numpy().astype(np.int64)
            ends, words_ = np.cumsum(sizes), held.flatten()
            raw = np.zeros(len(sizes) * dim)
            for lo in range(0, len(words_), WORDS):
                flat = words_.slice(lo, WORDS).dictionary_encode()
                slots = np.array([word_slots(w, dim) for w in flat.dictionary.to_pylist()], np.int64).reshape(-1, 3)
                place = np.arange(lo, lo + len(flat))
                doc = np.searchsorted(ends, place, "right")
                at = (doc[:, None] * dim + slots[flat.indices.to_numpy()]).ravel()
                np.add.at(raw, at, np.repeat(1.0 / (place - (ends - sizes)[doc] + 1), 3))
            raw = raw.reshape(-1, dim)
            norms = np.sqrt((raw * raw).sum(1, keepdims=True))
            unit = np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0)
            edges = pa.array(np.arange(len(sizes) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pa.array(unit.ravel()))], names=[key, "embedding"])

    return ws.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


#: Words whose slots and weights are held at once.
WORDS = 1 << 16


@lru_cache(maxsize=1 << 16)
def word_slots(word: str, dim: int) -> tuple[int, int, int]:
    """The three slots of a word: Spark's xxhash64 of the word and 0, 1, 2, modulo dim."""
    first = xxhash.xxh64_intdigest(word.encode(), 42)
    signed = lambda h: h - (h >> 63 << 64)
    return tuple(signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first)) % dim for k in range(3))
