"""Ranked lexical search: for each item the documents of highest score by its terms (operator 12).

Presence-mask grouping. Documents become an inverted index of parts: in a part every term of the items has its documents, and each posting its exact
share of a score. For an item a part's documents are grouped by mask, the bitmap of which of the item's terms they hold: each term's
documents get its bit, and equal masks are one group. A mask's highest possible score is the sum of its terms' highest shares in the part.
Masks are evaluated from the highest bound down, and none after the bound is below the least score among the best so far, which a task
carries from part to part. All scores are exact; a mask whose bound equals that least score is still evaluated, as a smaller id wins a tie.

Terms are the maximal stretches of ASCII letters and digits and all characters beyond ASCII, with A-Z as a-z. Terms are known by 64-bit hashes.

Steps: (1) the items' terms, by blocks of BLOCK_TERMS at most (a single item is never divided), go to all tasks; (2) one scan of the documents writes
the index of these terms: for each part packed postings, and counts of documents and terms; (3) counts are added up: one row a term of the block;
(4) every task searches its parts for all items of the block and gives its best k of each; (5) the best k of these are ranked. What reaches the driver
is bounded by BLOCK_TERMS; no item's documents are gathered anywhere, only k a task.

Defined results: null texts have no terms; items without terms or without an id have no rows; rows that share an item_id are one item with the terms
of all; documents are rows, so rows that share a doc_id are each ranked; rows without a doc_id count in the corpus's figures but are not ranked; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import small_batches, text_slices, written
from daftar.llm.words import lower, spans, word_hashes

#: Terms of the items (with repeats in different items) that one scan of the documents serves, 8 bytes each.
BLOCK_TERMS = 1 << 20
#: Postings and documents of a part of the index.
PART_POSTINGS, PART_DOCS = 1 << 19, 1 << 13
_BETWEEN = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BETWEEN[_a : _b + 1] = True
_SLICE = 2 << 20


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every term, and for each text the index of its first (one more at the end)."""
    starts, ends, first = spans(data, offsets, _BETWEEN)
    return word_hashes(lower(data), starts, ends), first


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: each item's distinct terms, in the order of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                terms, first = term_hashes(data, offsets)
                owner = np.repeat(rows.column("item_id").to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(terms.view(np.int64))], names=["item_id", "term"])

    pairs = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term long")
    return pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms")).orderBy("item_id")


def _blocks(terms: DataFrame) -> Iterator[list[tuple[int, list[int]]]]:
    """Items by blocks of BLOCK_TERMS terms at most, or of one item."""
    block, n = [], 0
    for row in terms.toLocalIterator():
        if block and n + len(row.terms) > BLOCK_TERMS:
            yield block
            block, n = [], 0
        block.append((row.item_id, row.terms))
        n += len(row.terms)
    if block:
        yield block


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *fields: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, n in fields:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The parts of the index: n_docs (documents with a term), n_terms (their terms), n_rows, n_postings, blob: id, number of terms and of postings of each document, then term (its place in the sorted vocabulary) and tf of each posting."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def part(pieces: list[tuple]) -> pa.RecordBatch:
        ids, n, postings, term, tf = (np.concatenate([p[i] for p in pieces]) for i in range(5))
        row = [int((n > 0).sum()), int(n.sum()), len(ids), len(term), _pack(ids, n, postings, term, tf)]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["n_docs", "n_terms", "n_rows", "n_postings", "blob"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces, size, rows_held = held.value, [], 0, 0
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                terms, first = term_hashes(data, offsets)
                sizes = np.diff(first)
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                mine = np.flatnonzero(known[at] == terms)
                doc = np.repeat(np.arange(len(sizes)), sizes)[mine]
                key = np.sort(doc * np.int64(len(known)) + at[mine])
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[new, len(key)])
                doc, term = key[new] // len(known), key[new] % len(known)
                ids = rows.column("doc_id")
                ids = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).min)
                pieces.append((ids, sizes.astype("<i4"), np.bincount(doc, minlength=len(sizes)).astype("<i4"), term.astype("<i4"), tf.astype("<i4")))
                size, rows_held = size + len(term), rows_held + len(sizes)
                if size >= PART_POSTINGS or rows_held >= PART_DOCS:
                    yield part(pieces)
                    pieces, size, rows_held = [], 0, 0
        if pieces:
            yield part(pieces)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "n_docs long, n_terms long, n_rows long, n_postings long, blob binary")


def _postings(rows: pa.RecordBatch, i: int) -> list[np.ndarray]:
    n, p = rows.column("n_rows")[i].as_py(), rows.column("n_postings")[i].as_py()
    return _unpack(rows.column("blob")[i].as_py(), ("<i8", n), ("<i4", n), ("<i4", n), ("<i4", p), ("<i4", p))


def document_counts(parts: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary: added up in tasks, then by term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_terms, np.int64)
        for rows in batches:
            for i in range(rows.num_rows):
                count += np.bincount(_postings(rows, i)[3], minlength=n_terms)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    found = parts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class _Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        some = score >= self.least
        score, doc = np.r_[self.score, score[some]], np.r_[self.doc, doc[some]]
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


class Part:
    """A part of the index, ready for searches: shares of scores by document and by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, postings: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids, self.named = ids, ids != np.iinfo(np.int64).min
        self.begun = np.r_[0, np.cumsum(postings, dtype=np.int64)]
        m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
        tf = tf.astype(np.int64)
        self.term = term
        self.share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, postings)))
        order = np.argsort(term, kind="stable")
        self.terms, begun = np.unique(term[order], return_index=True)
        self.doc_of = np.repeat(np.arange(len(ids)), postings)[order]
        self.edges = np.r_[begun, len(term)]
        self.most = np.maximum.reduceat(self.share[order], begun) if len(begun) else np.zeros(0, np.int64)
        self.asked = np.zeros(len(weights), bool)

    def groups(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold any of some terms (places in self.terms), those of one mask together; where each mask's documents begin, and the end; each mask's bound."""
        planes = np.zeros(((len(places) + 63) // 64, len(self.ids)), np.uint64)
        for j, p in enumerate(places.tolist()):
            planes[j >> 6, self.doc_of[self.edges[p] : self.edges[p + 1]]] |= np.uint64(1 << (j & 63))
        docs = np.flatnonzero(planes.any(0) & self.named)
        masks = planes[:, docs]
        order = np.argsort(masks[0], kind="stable") if len(masks) == 1 else np.lexsort(masks)
        docs, masks = docs[order], masks[:, order]
        first = np.flatnonzero(np.r_[True, (masks[:, 1:] != masks[:, :-1]).any(0)]) if len(docs) else np.zeros(0, np.int64)
        bits = np.unpackbits(np.ascontiguousarray(masks[:, first].T).view(np.uint8), axis=1, bitorder="little")[:, : len(places)]
        return docs, np.r_[first, len(docs)], bits @ self.most[places]

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The exact scores of some documents."""
        self.asked[terms] = True
        n = self.begun[docs + 1] - self.begun[docs]
        begun = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(begun, n) + np.repeat(self.begun[docs], n)
        share = np.where(self.asked[self.term[at]], self.share[at], 0)
        self.asked[terms] = False
        return np.add.reduceat(share, begun)

    def search(self, terms: np.ndarray, best: _Best) -> None:
        places = np.searchsorted(self.terms, terms)
        held = places < len(self.terms)
        held[held] = self.terms[places[held]] == terms[held]
        places = places[held]
        if not len(places) or self.most[places].sum() < best.least:
            return
        docs, edges, bound = self.groups(places)
        order = np.argsort(-bound, kind="stable")
        done, step = 0, 1
        while done < len(order) and bound[order[done]] >= best.least:
            now = order[done : done + step]
            now = now[bound[now] >= best.least]
            some = np.concatenate([docs[edges[g] : edges[g + 1]] for g in now.tolist()])
            best.add(self.scores(some, terms), self.ids[some])
            done, step = done + len(now), 2 * step


def _search_block(docs: DataFrame, block: list[tuple[int, list[int]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    sizes = np.array([len(t) for _, t in block])
    every = np.array([t for _, ts in block for t in ts], np.int64).view(np.uint64)
    vocabulary, place = np.unique(every, return_inverse=True)
    parts = written(index(docs, vocabulary))
    total = parts.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total.n or 0, total.l or 0
    df = document_counts(parts, len(vocabulary))
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    asked = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), place.astype(np.int32), np.r_[0, np.cumsum(sizes)], weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place, edges, weights = asked.value
        own = [np.sort(place[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        best = [_Best(k) for _ in items]
        for rows in batches:
            for i in range(rows.num_rows):
                part = Part(*_postings(rows, i), weights, n_docs, n_terms)
                for terms, b in zip(own, best, strict=True):
                    part.search(terms, b)
        n = np.array([len(b.doc) for b in best], np.int64)
        columns = [np.repeat(items, n), np.concatenate([b.doc for b in best]), np.concatenate([b.score for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return parts.where("n_terms > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0, equal scores by ascending doc_id. docs: doc_id long, text; items: item_id long, text.

    The index stays in the shared folder, as the result reads it.
    """
    found = [_search_block(docs, block, k) for block in _blocks(item_terms(items))]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
