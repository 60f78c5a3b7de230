"""Removes words covered by long passages that stand in a document with a smaller id (operator 6).

Difference-cover anchors: of every text only runs of ANCHOR words at places that are in COVER modulo PERIOD are hashed. Two equal passages of
WINDOW words, wherever they begin, have a pair of such runs at the same distance from their beginnings, as every shift modulo PERIOD is a
difference of two members of COVER. Anchors that two documents share extend to the windows of WINDOW words around them, and only these windows are compared, by
96-bit hashes: a window whose words also begin in a document with a smaller id marks its words.

A text that equals, word by word, one with a smaller id is settled by a hash of the whole (95 bits of xxh3-128 over its bytes), so groups of copies cost one entry each. The entry carries a hash of
its row's text, so that of the rows with one id only the equal ones are settled.

Steps: (1) a scan sends anchors to buckets (see matching); (2) documents that a Bloom filter of ids picks meet their shared anchors: untouched ones are done, the
others send their windows to buckets and are written with them to the shared folder; (3) these documents meet their
marked windows.

Defined results: null and empty texts have no words; documents without an id lose nothing and take nothing from others; rows with the same id don't
judge each other; windows are judged on the input; a document with fewer than WINDOW words loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm import bloom, matching
from daftar.llm.common import buckets_for, discard, small_batches, text_slices, with_own_names, written
from daftar.llm.words import run_hashes, spans, whole_hashes, word_hashes

WINDOW, PERIOD = 50, 31
#: A perfect difference set: its 30 differences modulo 31 are 1 to 30, each once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_SLICE = 1 << 20


def anchor_places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of all anchors; first: index of each document's first word, and the end."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    at = np.isin(pos % PERIOD, COVER) & (pos + ANCHOR <= sizes[doc]) & (sizes[doc] >= WINDOW)
    return doc[at], pos[at]


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                starts, ends, first = spans(data, offsets)
                words = word_hashes(data, starts, ends)
                ids, f = rows.column("doc_id").to_numpy(), rows.column("__f").to_numpy()
                doc, pos = anchor_places(first)
                sizes = np.diff(first)
                long = np.flatnonzero(sizes >= WINDOW)
                low, high = whole_hashes(data.tobytes(), offsets.tolist(), long.tolist())
                whole = matching.entries(low, (high & np.uint64(0x7FFFFFFF) | np.uint64(1 << 31)).astype(np.uint32), ids[long], f[long], -1)
                part = matching.entries(run_hashes(words, first[doc] + pos, ANCHOR), 0, ids[doc], 0, pos)
                numbers, blobs = matching.blocks(np.concatenate([part, whole]), buckets)
                yield pa.RecordBatch.from_arrays([numbers, blobs], names=["bucket", "blob"])

    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("__f")).mapInArrow(run, "bucket int, blob binary")


def windows_near(shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the windows that hold a shared anchor; shared: a flag per word."""
    total = np.concatenate([[0], np.cumsum(shared)])
    sizes = np.diff(first)
    last = np.repeat(first[1:], sizes)
    at = np.arange(len(shared))
    fits = at + WINDOW <= last
    return at[fits & (total[np.minimum(at + PERIOD, len(shared))] > total[at])]


def _text(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def remove(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs (doc_id long, text, further columns) with text cut to the kept words, and n_words, n_removed; untouched texts stay as they are.

    digest: instead of text, kept_sha256 of the kept words joined by one space. Columns n_words, n_removed, kept_sha256 of the input are replaced; all others, of any name, are kept.
    """
    return with_own_names(lambda d: _remove(d, digest), docs.drop("n_words", "n_removed", "kept_sha256"), "__")


def _remove(docs: DataFrame, digest: bool) -> DataFrame:
    docs = small_batches(docs)
    buckets = buckets_for(docs)
    near = written(matching.hits(_anchors(docs, buckets), buckets).select(F.col("doc_id").alias("__doc"), F.col("places").alias("__places"), F.col("whole").alias("__whole")))
    some_near = docs.sparkSession.sparkContext.broadcast(bloom.of_column(near, "__doc"))

    def maybe_near(batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose documents may have shared anchors: only these move to meet theirs."""
        ids = batch.column("doc_id")
        return bloom.maybe(some_near.value, pc.fill_null(ids, 0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)

    def picked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_near(batch)))

    marked = docs.withColumn("__f", F.xxhash64("text"))
    alone = marked.withColumns({c: F.lit(None).cast("binary") for c in ("__places", "__whole")})
    met = marked.mapInArrow(picked, marked.schema).join(near, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    kept = [f for f in docs.schema.fields if not digest or f.name != "text"]
    result = [*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *([T.StructField("kept_sha256", T.StringType())] if digest else [])]

    def finish(rows: pa.RecordBatch, texts: list, n_words: np.ndarray, removed: np.ndarray, hashed: list | None) -> list:
        """Columns of `result`."""
        columns = [pa.array(texts, pa.string()) if f.name == "text" else rows.column(f.name) for f in kept]
        return [*columns, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), *([pa.array(hashed, pa.string())] if digest else [])]

    def sort_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_arrow(f.dataType) for f in staged.fields]
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                starts, ends, first = spans(data, offsets)
                sizes, whole = np.diff(first), data.tobytes()
                shared, twin, touched = np.zeros(len(starts), bool), np.zeros(rows.num_rows, bool), np.zeros(rows.num_rows, bool)
                ids, f = pc.fill_null(rows.column("doc_id"), 0).to_numpy(), rows.column("__f").to_numpy()
                for i, hashes in matching.places(rows.column("__whole"), "<i8"):
                    twin[i] = f[i] in hashes
                for i, at in matching.places(rows.column("__places")):
                    at = at[at < sizes[i]]  # rows with one id have each other's places
                    if not twin[i]:
                        shared[first[i] + at] = True
                windows = windows_near(shared, first)
                owner = np.searchsorted(first, windows, "right") - 1
                touched[owner] = True
                done = np.flatnonzero(~touched)
                hashed, texts = [], []
                if digest:
                    hashed = [hashlib.sha256(b"" if twin[i] else b" ".join(whole[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in done.tolist()]
                else:
                    original = rows.column("text").to_pylist()
                    texts = ["" if twin[i] else original[i] for i in done.tolist()]
                some = rows.take(pa.array(done))
                n = len(done)
                yield _staged(kinds, [pa.array([0] * n, pa.int32()), *finish(some, texts, sizes[done], np.where(twin[done], sizes[done], 0), hashed), *([None] * 4)], n)
                if not len(windows):
                    continue
                words = word_hashes(data, starts, ends)
                g = (run_hashes(words, windows, WINDOW, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                numbers, blobs = matching.blocks(matching.entries(run_hashes(words, windows, WINDOW, 1), g, ids[owner], f[owner], (windows - first[owner]).astype(np.int32)), buckets)
                n = len(numbers)
                yield _staged(kinds, [pa.array([1] * n, pa.int32()), *([None] * len(result)), None, None, numbers, blobs], n)
                left = np.flatnonzero(touched)
                some = rows.take(pa.array(left))
                n = len(left)
                yield _staged(kinds, [pa.array([2] * n, pa.int32()), *finish(some, some.column("text").to_pylist(), sizes[left], np.zeros(n, np.int64), [None] * n), some.column("text"), some.column("__f"), None, None], n)

    def sort_out_alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sort_out(batch.filter(pa.array(~maybe_near(batch))) for batch in batches)

    staged = T.StructType([T.StructField("__kind", T.IntegerType()), *result, T.StructField("__text", T.StringType()), T.StructField("__f", T.LongType()), T.StructField("__bucket", T.IntegerType()), T.StructField("__blob", T.BinaryType())])
    stage = written(alone.mapInArrow(sort_out_alone, staged).union(met.mapInArrow(sort_out, staged)))
    discard(near)
    marks = matching.hits(stage.where("__kind = 1").select(F.col("__bucket").alias("bucket"), F.col("__blob").alias("blob")), buckets).select(F.col("doc_id").alias("__doc"), F.col("f").alias("__mark"), F.col("places").alias("__places"))
    open_rows = stage.where("__kind = 2").join(marks, (F.col("doc_id") == F.col("__doc")) & (F.col("__f") == F.col("__mark")), "left").drop("__doc", "__mark", "__kind", "__bucket", "__blob")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "__text", _SLICE):
                starts, ends, first = spans(data, offsets)
                change = np.zeros(len(starts) + 1, np.int64)
                for i, at in matching.places(rows.column("__places")):
                    np.add.at(change, first[i] + at, 1)
                    np.add.at(change, np.minimum(first[i] + at + WINDOW, first[i + 1]), -1)
                keep = np.cumsum(change)[:-1] == 0 if len(starts) else np.zeros(0, bool)
                total = np.concatenate([[0], np.cumsum(~keep)])
                removed, whole = total[first[1:]] - total[first[:-1]], data.tobytes()
                texts, original = [], rows.column("__text").to_pylist()
                for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                    k = np.flatnonzero(keep[a:b]) + a
                    texts.append(_text(whole, starts[k], ends[k]))
                hashed = [hashlib.sha256(t).hexdigest() for t in texts] if digest else None
                texts = [o if r == 0 else t.decode() for o, r, t in zip(original, removed.tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(finish(rows, texts, np.diff(first), removed, hashed), schema=_schema(result))

    out = T.StructType(result)
    columns = out.names
    return stage.where("__kind = 0").select(*columns).unionByName(open_rows.mapInArrow(cut, out).select(*columns))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _schema(fields: list[T.StructField]) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])


def _staged(kinds: list[pa.DataType], columns: list, n: int) -> pa.RecordBatch:
    """A batch of the staged table; None: a column of nulls."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])
