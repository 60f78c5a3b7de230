"""Removes bytes covered by strings of DEPTH bytes that also start in a document with a smaller id (operator 13).

Depth-limited radix sort of all suffixes: most-significant digits first and no deeper than DEPTH bytes, so that the groups that are left equal are
exactly the strings of DEPTH bytes that stand in several places.

* The first digit is the one by which suffixes are dealt to tasks: of the runs of GRAM bytes in a suffix's first DEPTH bytes that of least hash
  (the leftmost of equal ones), and its place. It depends on these bytes alone, so equal strings meet. Suffixes that begin one after the other mostly
  share it, and travel as one piece of text, about three bytes a suffix instead of DEPTH. Equal pieces of a slice of texts travel once, for
  the smallest document that holds them; the others are covered already. So a passage or text that very many documents hold costs
  one piece a slice.
* In a bucket equal pieces are one. The second digit is the HALF bytes beside the run of GRAM bytes on the side where the string has the most of
  them; it is looked at once a piece. Suffixes of pieces that no other document's piece agrees with are out.
* The suffixes that are left are sorted by digits of eight bytes, from the first; after each pass groups within one document drop out.

Covered places go back packed, by document. Only documents that a Bloom filter of ids picks meet them; the other texts don't move.

Defined results: null and empty texts have no bytes; documents without an id lose nothing and take nothing from others; rows with the same id don't
judge each other; strings are judged on the input; texts shorter than DEPTH lose nothing. What is kept need not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm import bloom
from daftar.llm.common import arrow_type, buckets_for, discard, release, small_batches, text_slices, written

DEPTH, GRAM = 50, 12
#: Runs of GRAM bytes in a string; a string has HALF bytes at least before or after each.
_RUNS = DEPTH - GRAM + 1
HALF = (DEPTH - GRAM) // 2
#: Bytes of text whose equal pieces travel once, and places judged at a time.
_SLICE, _STEP = 4 << 20, 1 << 16
#: Buckets a shuffle partition, as a piece stands for a third of its bytes.
_FINER = 8
#: Of zstandard, for pieces: they are most of what moves.
_LEVEL = 5
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SPAN = np.dtype([("doc", "<i8"), ("f", "<i8"), ("a", "<i4"), ("b", "<i4")])


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those of the next."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _eights(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from every place on, zeros behind the end."""
    return np.ndarray(len(data) + DEPTH, order, np.concatenate([data, np.zeros(DEPTH + 8, np.uint8)]), strides=(1,))


def _gram(eights: np.ndarray, at: np.ndarray | slice, later: np.ndarray | slice) -> np.ndarray:
    return ((eights[at] * _K1) ^ eights[later]) * _K2


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffixes, distance to its run of least hash) of the pieces of all texts: suffixes that begin one after the other and share their first digit."""
    n, mask = len(data), np.uint64(2 * _STEP - 1)
    eights = _eights(data)
    fits = np.arange(n) + DEPTH <= np.repeat(offsets[1:], np.diff(offsets))
    out = []
    for lo in range(0, n, _STEP):
        many = min(n - lo, _STEP) + _RUNS - 1
        # The hash's upper bits and, below them, the place: the least is the leftmost of the least.
        least = _gram(eights, slice(lo, lo + many), slice(lo + GRAM - 8, lo + GRAM - 8 + many))
        least = (least & ~mask) | np.arange(len(least), dtype=np.uint64)
        size = 1
        while 2 * size <= _RUNS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (_RUNS - size)], least[_RUNS - size :])
        run = (least & mask).astype(np.int64)
        fit = fits[lo : lo + len(run)]
        turn = np.r_[True, (run[1:] != run[:-1]) | ~fit[:-1] | ~fit[1:]]
        first, last = np.flatnonzero(fit & turn), np.flatnonzero(fit & np.r_[turn[1:], True])
        out.append((first + lo, last - first + 1, run[first] - first))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def _same(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for each piece of n bytes at a place, equal for equal pieces (by a hash of 64 bits)."""
    view = memoryview(data)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (at + n).tolist(), strict=True)), np.uint64, len(at))
    return np.unique(hashed, return_inverse=True)[1]


def merged(doc: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SPANs from a to b of rows, with those that touch or overlap as one, in order."""
    order = np.lexsort((a, f, doc))
    doc, f, a, b = doc[order], f[order], a[order], b[order]
    row = np.r_[True, (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])] if len(doc) else np.zeros(0, bool)
    base = np.cumsum(row) << 32
    reach = np.maximum.accumulate(b + base) if len(doc) else b
    new = row.copy()
    new[1:] |= (a + base)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = np.empty(len(first), SPAN)
    out["doc"], out["f"], out["a"] = doc[first], f[first], a[first]
    out["b"] = (reach - base)[np.r_[first[1:], len(doc)] - 1] if len(first) else 0
    return out


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _spans_by_document(spans: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    to = ((spans["doc"].view(np.uint64) * _K1) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    spans, edges = spans[order], np.searchsorted(to[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges)).tolist()
    return some, [_pack(*(spans[edges[t] : edges[t + 1]][c] for c in SPAN.names)) for t in some]


def _unpacked_spans(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // SPAN.itemsize, 0
    out = np.empty(n, SPAN)
    for c in SPAN.names:
        out[c] = np.frombuffer(raw, SPAN[c], n, at)
        at += n * SPAN[c].itemsize
    return out


def dealt(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, f: np.ndarray, buckets: int, to: int) -> tuple[list[int], list[bytes]]:
    """Buckets and packed pieces of a slice of texts; what the slice itself shows to be covered, by document, in negative buckets."""
    at, n, beside = pieces(data, offsets)
    row = np.searchsorted(offsets, at, "right") - 1
    same = _same(data, at, n + DEPTH - 1)
    least = np.full(same.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[row])
    own = ids[row] == least[same]
    gone = np.flatnonzero(~own)
    start = at - offsets[row]
    numbers, blobs = _spans_by_document(merged(ids[row[gone]], f[row[gone]], start[gone], start[gone] + n[gone] + DEPTH - 1), to)
    numbers = [-1 - t for t in numbers]
    # Every piece once, with all its places in the smallest document.
    places = np.flatnonzero(own)
    places = places[np.argsort(same[places], kind="stable")]
    begun = np.flatnonzero(np.r_[True, same[places[1:]] != same[places[:-1]]]) if len(places) else places
    each, first = np.diff(np.r_[begun, len(places)]), places[begun]
    order = np.argsort(first)
    begun, each, first = begun[order], each[order], first[order]
    eights = _eights(data)
    bucket = ((_gram(eights, at[first] + beside[first], at[first] + beside[first] + GRAM - 8) >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        s = order[edges[b] : edges[b + 1]]
        p = places[ragged(begun[s], each[s])]
        rows, of = np.unique(row[p], return_inverse=True)
        head = np.array([len(s), len(p), len(rows)], "<i8")
        text = data[ragged(at[first[s]], n[first[s]] + DEPTH - 1)]
        blobs.append(_pack(head, ids[rows], f[rows], each[s].astype("<i4"), of.astype("<i4"), start[p].astype("<i4"), n[first[s]].astype("u1"), beside[first[s]].astype("u1"), text, level=_LEVEL))
        numbers.append(b)
    return numbers, blobs


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """text; of each piece where it begins, its suffixes, the distance to its run, its document and its places' number; of each place its document, f and start."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, p, r = np.frombuffer(raw, "<i8", 3).tolist()
        at, got = 24, []
        for kind, many in (("<i8", r), ("<i8", r), ("<i4", n), ("<i4", p), ("<i4", p), ("u1", n), ("u1", n)):
            got.append(np.frombuffer(raw, kind, many, at))
            at += got[-1].nbytes
        ids, f, each, of, start, many, beside = got
        first = np.cumsum(each) - each
        for held, x in zip(parts, (np.frombuffer(raw, np.uint8, offset=at), many, beside, ids[of[first]], each, ids[of], f[of], start), strict=True):
            held.append(x)
    text, many, beside, doc, each, place_doc, place_f, start = (np.concatenate(x) for x in parts)
    many, beside, each = many.astype(np.int64), beside.astype(np.int64), each.astype(np.int64)
    size = many + DEPTH - 1
    return text, np.cumsum(size) - size, many, beside, doc, each, place_doc, place_f, start.astype(np.int64)


def _in_several(doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of members of groups (each group together), a flag: whether the group holds several documents."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, bool)
    n = np.diff(np.r_[first, len(group)])
    return np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), n)


def covered_suffixes(text: np.ndarray, at: np.ndarray, many: np.ndarray, beside: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, suffix in it) of the suffixes of different pieces whose first DEPTH bytes also begin one of a smaller document, in order."""
    eights = _eights(text)
    run = at + beside
    gram = _gram(eights, run, run + GRAM - 8)

    def shared(keys: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        """Those of some pieces whose keys a piece of another document has too."""
        order = np.lexsort([k[some] for k in keys])
        some = some[order]
        group = np.cumsum(np.r_[True, np.any([k[some[1:]] != k[some[:-1]] for k in keys], axis=0)]) if len(some) else some
        return some[_in_several(doc[some], group)]

    some = shared([gram], np.arange(len(at)))
    before = np.zeros(len(at), bool)
    after = np.zeros(len(at), bool)
    with_before = some[beside[some] >= HALF]
    with_after = some[many[some] - 1 + DEPTH - beside[some] >= GRAM + HALF]
    sides = ((before, with_before, -HALF), (after, with_after, GRAM))
    for flags, held, shift in sides:
        keys = [np.zeros(len(at), np.uint64) for _ in range(3)]
        for key, step in zip(keys, (0, 8, HALF - 8), strict=True):
            key[held] = eights[run[held] + shift + step]
        flags[shared([*keys, gram], held)] = True
    left = some[before[some] | after[some]]
    piece = np.repeat(left, many[left])
    suffix = ragged(np.zeros(len(left), np.int64), many[left])
    distance = beside[piece] - suffix
    open_ = np.where(distance >= HALF, before[piece], after[piece])
    piece, suffix, distance = piece[open_], suffix[open_], distance[open_]
    digits = _eights(text, ">u8")
    group = np.unique(gram[piece] * np.uint64(64) + distance.astype(np.uint64), return_inverse=True)[1] if len(piece) else piece
    for depth in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        digit = digits[at[piece] + suffix + depth].astype(np.uint64)
        order = np.lexsort((digit, group))
        piece, suffix, group, digit = piece[order], suffix[order], group[order], digit[order]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(group) else group
        several = _in_several(doc[piece], group)
        piece, suffix, group = piece[several], suffix[several], group[several]
    if not len(piece):
        return piece, suffix
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(doc[piece], first), np.diff(np.r_[first, len(group)]))
    hit = doc[piece] > least
    piece, suffix = piece[hit], suffix[hit]
    order = np.lexsort((suffix, piece))
    return piece[order], suffix[order]


def judged(blobs: list[bytes]) -> np.ndarray:
    """SPANs that the pieces of a bucket show to be covered."""
    text, at, many, beside, doc, each, place_doc, place_f, start = _unpacked(blobs)
    same = _same(text, at, many + DEPTH - 1)
    least = np.full(same.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    first = np.full(len(least), -1)
    first[same[::-1]] = np.arange(len(same))[::-1]  # one piece of equal ones
    piece, suffix = covered_suffixes(text, at[first], many[first], beside[first], least)
    turn = np.r_[True, (piece[1:] != piece[:-1]) | (suffix[1:] != suffix[:-1] + 1)] if len(piece) else np.zeros(0, bool)
    lo, hi = np.flatnonzero(turn), np.r_[np.flatnonzero(turn)[1:], len(piece)] - 1
    edges = np.searchsorted(piece[lo], np.arange(len(least) + 1))
    of = np.repeat(np.arange(len(at)), each)  # piece of each place
    whole = np.flatnonzero(place_doc > least[same[of]])
    rest = np.flatnonzero(place_doc == least[same[of]])
    n = edges[same[of[rest]] + 1] - edges[same[of[rest]]]
    s, rest = ragged(edges[same[of[rest]]], n), np.repeat(rest, n)
    a = np.r_[start[whole], start[rest] + suffix[lo[s]]]
    b = np.r_[start[whole] + many[of[whole]], start[rest] + suffix[hi[s]] + 1] + DEPTH - 1
    both = np.r_[whole, rest]
    return merged(place_doc[both], place_f[both], a, b)


def covered(docs: DataFrame) -> DataFrame:
    """Covered bytes of rows: doc_id, f (xxhash64 of the text), spans (packed pairs of 32-bit integers: from, to); none for rows without any."""
    to = buckets_for(docs)
    buckets = to * _FINER

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                numbers, blobs = dealt(data, offsets, rows.column("doc_id").to_numpy(), rows.column("f").to_numpy(), buckets, to)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def judge(table: pa.Table) -> pa.Table:
        release()
        blobs = table.column("blob").to_pylist()
        if (bucket := table.column("bucket")[0].as_py()) < 0:
            return pa.table({"to": pa.array([-1 - bucket] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
        numbers, blobs = _spans_by_document(judged(blobs), to)
        return pa.table({"to": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        release()
        s = np.concatenate([_unpacked_spans(b) for b in table.column("blob").to_pylist()])
        s = merged(s["doc"], s["f"], s["a"].astype(np.int64), s["b"].astype(np.int64))
        first = np.flatnonzero(np.r_[True, (s["doc"][1:] != s["doc"][:-1]) | (s["f"][1:] != s["f"][:-1])])
        pairs, edges = np.stack([s["a"], s["b"]], 1), np.r_[first, len(s)].tolist()
        return pa.table({"doc_id": s["doc"][first], "f": s["f"][first], "spans": pa.array([pairs[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary())})

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("f")).mapInArrow(deal, "bucket int, blob binary")
    found = rows.groupBy("bucket").applyInArrow(judge, "to int, blob binary")
    return found.groupBy("to").applyInArrow(gather, "doc_id long, f long, spans binary")


def remove(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The rows of docs (doc_id long, text, further columns) without text, with kept (binary: the bytes left), n_bytes (before), n_removed and n_spans (maximal removed runs).

    digest: kept_sha256 (lowercase hex) instead of kept. Columns of these names in the input are replaced. The spans stay in the shared folder, as the result reads them.
    """
    docs = small_batches(docs).drop("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("int")
    docs = docs.select("doc_id", "text", held.alias("rest"))  # so that no column clashes with those below
    found = written(covered(docs))
    some = docs.sparkSession.sparkContext.broadcast(bloom.of_column(found, "doc_id"))

    def chosen(batches: Iterable[pa.RecordBatch], touched: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            maybe = bloom.maybe(some.value, pc.fill_null(ids, 0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(maybe == touched))

    names = [f.name for f in docs.schema.fields if f.name != "text"]
    kept = T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType())
    result = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), kept])
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in result.fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                whole, left, removed, spans = data.tobytes(), [], np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                packed = rows.column("spans").to_pylist() if "spans" in rows.schema.names else [None] * rows.num_rows
                for i, (a, b, s) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), packed, strict=True)):
                    if s:
                        pairs = np.frombuffer(s, "<i4").astype(np.int64).reshape(-1, 2)
                        removed[i], spans[i] = (pairs[:, 1] - pairs[:, 0]).sum(), len(pairs)
                        text = b"".join(whole[x:y] for x, y in zip([a, *(a + pairs[:, 1]).tolist()], [*(a + pairs[:, 0]).tolist(), b], strict=True))
                    else:
                        text = whole[a:b]
                    left.append(hashlib.sha256(text).hexdigest() if digest else text)
                columns = [*(rows.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(left)]
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    alone = docs.mapInArrow(lambda batches: cut(chosen(batches, False)), result)
    moved = docs.mapInArrow(lambda batches: chosen(batches, True), docs.schema).withColumn("f", F.xxhash64("text"))
    met = moved.join(found.select(F.col("doc_id").alias("of"), F.col("f").alias("of_f"), "spans"), (F.col("doc_id") == F.col("of")) & (F.col("f") == F.col("of_f")), "left").drop("of", "of_f")
    out = alone.unionByName(met.mapInArrow(cut, result))
    return out.select("doc_id", *(F.col("rest").getField(c).alias(c) for c in rest), "n_bytes", "n_removed", "n_spans", kept.name)
