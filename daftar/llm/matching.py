"""Which documents share a hash: entries (key, document, place) are dealt by key into buckets and judged bucket by bucket.

Entries travel packed: a task sends one compressed block per bucket and slice of texts, not a row per entry. Within a slice equal keys of several documents are
judged at once and only the smallest document's entries go on, so the bucket of a key that very many documents hold receives one
document per slice of text, not one per document. The number of buckets follows the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from daftar.llm.common import release

ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("f", "<i8"), ("pos", "<i4")])
_COLUMNS = [n for n in ENTRY.names]


def entries(h: np.ndarray, g: np.ndarray | int, doc: np.ndarray, f: np.ndarray | int, pos: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(h), ENTRY)
    out["h"], out["g"], out["doc"], out["f"], out["pos"] = h, g, doc, f, pos
    return out


def pack(e: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(e[c]).tobytes() for c in _COLUMNS))


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // ENTRY.itemsize
    out, at = np.empty(n, ENTRY), 0
    for c in _COLUMNS:
        size = ENTRY[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], ENTRY[c])
        at += size
    return out


def _groups(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e sorted by key and document; for each entry its group's smallest and greatest document."""
    e = e[np.lexsort((e["doc"], e["g"], e["h"]))]
    if not len(e):
        return e, e["doc"], e["doc"]
    new = np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(e)])
    return e, np.repeat(e["doc"][first], size), np.repeat(e["doc"][first + size - 1], size)


def judged(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose key a smaller document also holds (whole-text entries, pos -1, and windows, g not 0) or any other document does (anchors), and the rest's and groups' representatives to send on."""
    e, least, most = _groups(e)
    anchor = (e["g"] == 0) & (e["pos"] >= 0)
    hit = np.where(anchor, least != most, e["doc"] > least)
    return e[hit], e[e["doc"] == least]


def blocks(e: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Bucket numbers and packed blocks: hits go to negative buckets, which nobody judges again."""
    hits, rest = judged(e)
    numbers, blobs = [], []
    for part, negative in ((hits, True), (rest, False)):
        at = (part["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        part, at = part[order], at[order]
        edges = np.searchsorted(at, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            numbers.append(-1 - b if negative else b)
            blobs.append(pack(np.sort(part[edges[b] : edges[b + 1]], order=("doc", "pos"))))
    return pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())


def hits(rows: DataFrame, buckets: int) -> DataFrame:
    """From rows (bucket, blob) the hits, one row per document: doc_id, f, places (packed 32-bit integers, no more than its words), and whole: f of its whole-text entries (packed 64-bit integers), which count to its row of f = 0."""

    def judge(table: pa.Table) -> pa.Table:
        release()
        e = np.concatenate([unpack(b) for b in table.column("blob").to_pylist()])
        if table.column("bucket")[0].as_py() >= 0:
            e = judged(e)[0]
        to = (e["doc"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        e, to = e[order], to[order]
        edges = np.searchsorted(to, np.arange(buckets + 1))
        numbers = np.flatnonzero(np.diff(edges))
        return pa.table({"to": pa.array(numbers, pa.int32()), "blob": pa.array([pack(np.sort(e[edges[b] : edges[b + 1]], order=("doc", "pos"))) for b in numbers.tolist()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        release()
        e = np.concatenate([unpack(b) for b in table.column("blob").to_pylist()])
        whole = e["pos"] < 0
        of = e["f"].copy()
        e["f"][whole] = 0
        order = np.lexsort((e["pos"], e["f"], e["doc"]))
        e, of, whole = e[order], of[order], whole[order]
        new = np.flatnonzero(np.r_[True, (e["doc"][1:] != e["doc"][:-1]) | (e["f"][1:] != e["f"][:-1])]) if len(e) else np.zeros(0, np.int64)
        edges = np.r_[new, len(e)].tolist()
        middle = (new + np.add.reduceat(whole, new, dtype=np.int64)).tolist() if len(e) else []  # whole-text entries come first
        pos = np.ascontiguousarray(e["pos"])
        return pa.table({"doc_id": pa.array(e["doc"][new], pa.int64()), "f": pa.array(e["f"][new], pa.int64()), "places": pa.array([pos[a:b].tobytes() for a, b in zip(middle, edges[1:], strict=True)], pa.binary()), "whole": pa.array([np.unique(of[a:b]).tobytes() for a, b in zip(edges, middle, strict=False)], pa.binary())})

    found = rows.select("bucket", "blob").groupBy("bucket").applyInArrow(judge, "to int, blob binary")
    return found.groupBy("to").applyInArrow(gather, "doc_id long, f long, places binary, whole binary")


def places(column: pa.Array, kind: str = "<i4") -> Iterator[tuple[int, np.ndarray]]:
    """(row, its places) of the rows that have any; with kind <i8, its whole-text hashes."""
    for i, packed in enumerate(column.to_pylist()):
        if packed:
            yield i, np.frombuffer(packed, kind).astype(np.int64)
