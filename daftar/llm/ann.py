"""Approximate nearest neighbours by adaptive dimension scan (operator 1).

Largest inner product is turned into nearest distance by one further component, sqrt(M^2 - |x|^2) with M the
greatest norm. Vectors are rotated at random and dealt into lists by centroids fitted on a bounded sample (a SHARE of the rows, SAMPLE at most, by
hash of id); every row is indexed. A query probes the share PROBED of lists that lie nearest. In a probed block the rotated
vectors stand in column blocks: after each block of columns a hypothesis test on the partial distance abandons
candidates that are, with high confidence, farther than the kth distance known so far: that of the sample at first, a true bound, then
that of the rows of the block already read. Survivors get the exact inner product of the original vectors, summed in order in double precision.

Lists are dealt into blocks of bounded size by a salt from their counts, so equal vectors, however many,
spread over tasks. Queries are dealt into chunks likewise.

Defined results: vectors null, empty, zero, with null or non-finite components, or without an id take no part; so do those of another length than
the most frequent, which have no inner product with the rest; every row but those with the query's own id is a candidate, so an id that stands in several rows
may take several places; an id queried twice is one query (its least vector); an empty table gives no rows. Fewer than k candidates: all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import vectors
from daftar.llm.common import written

SAMPLE, SHARE, ROWS_PER_LIST, MOST_LISTS, PROBED = 2048, 0.05, 512, 1024, 0.7
COLUMNS, ROWS = 16, 1024
EPSILON = 1.5
_FOUND = "query_id long, vec_id long, score double, sampled boolean"


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by Lloyd's iterations on the sample."""
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(8):
        near = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def scan(x: np.ndarray, q: np.ndarray, far: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may lie within `far`, the squared distance of each query's kth known row. x and q are rotated.

    After each block of columns a pair is abandoned if its partial distance, scaled to all columns, exceeds far by more than the test allows; rows and
    queries without a pair left are dropped before the next block.
    """
    d = x.shape[1]
    rows, queries = np.arange(len(x)), np.arange(len(q))
    partial = np.zeros((len(q), len(x)))
    for lo in range(0, d, COLUMNS):
        hi = min(lo + COLUMNS, d)
        a, b = x[rows, lo:hi], q[queries, lo:hi]
        partial += (a**2).sum(1)[None] + (b**2).sum(1)[:, None] - 2 * b @ a.T
        if hi == d:
            break
        alive = partial * (d / hi) <= (far[queries] * (1 + epsilon / np.sqrt(hi)) ** 2)[:, None]
        partial[~alive] = np.inf
        some_rows, some_queries = alive.any(0), alive.any(1)
        if not some_rows.all() or not some_queries.all():
            rows, queries, partial = rows[some_rows], queries[some_queries], partial[np.ix_(some_queries, some_rows)]
    i, j = np.nonzero(partial <= (far[queries] * (1 + 1e-9) + 1e-9)[:, None])
    return queries[i], rows[j]


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of components."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[:, j] * q[:, j]
    return s


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED) -> DataFrame:
    """The k rows of largest inner product found for each query: query_id, rank, vec_id, score. A row with the query's own id is not its candidate."""
    data = vectors.usable(rows, id_col, vector_col, allow_zero=False)
    asked = vectors.usable(queries, id_col, vector_col, allow_zero=False).groupBy("vec_id").agg(F.min("v").alias("v"))
    stat = data.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    n, most = stat["n"], stat["m"] or 0.0
    fit_ids, fit = vectors.sample(data, max(1, min(SAMPLE, int(SHARE * n)))) if n else (np.zeros(0, np.int64), np.zeros((0, 1)))
    d = fit.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(2).normal(size=(d, d)))[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]]) @ rotation

    centroids = _fit(lifted(fit), max(1, min(MOST_LISTS, n // ROWS_PER_LIST, len(fit) // 4))) if n else np.zeros((1, d))
    half = 0.5 * (centroids**2).sum(1)
    indexed = written(vectors.assigned(data, lambda x: np.argmax(lifted(x) @ centroids.T - half, axis=1)))
    per_list = vectors.salts(indexed)
    chunks = vectors.chunks_of(asked.count() if n else 0)
    probes = max(1, int(np.ceil(probed * len(centroids))))

    def known(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The kth best score in the sample, which bounds the kth best of all from below."""
        if len(fit) <= k:
            return np.full(len(x), -np.inf)
        score = np.where(ids[:, None] == fit_ids[None], -np.inf, x @ fit.T)
        return np.partition(score, len(fit) - k, axis=1)[:, len(fit) - k]

    def from_sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that set the bound, so that no query is left with fewer than k."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x, own = vectors.matrix(part.column("v")), part.column("vec_id").to_numpy()
                score = np.where(own[:, None] == fit_ids[None], -np.inf, x @ fit.T)
                near = np.argsort(-score, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(x)), near.shape[1])
                j = near.ravel()
                other = own[i] != fit_ids[j]
                i, j = i[other], j[other]
                yield pa.RecordBatch.from_arrays([pa.array(own[i], pa.int64()), pa.array(fit_ids[j], pa.int64()), pa.array(inner_products(fit[j], x[i])), pa.array(np.ones(len(i), bool))], names=["query_id", "vec_id", "score", "sampled"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x = vectors.matrix(part.column("v"))
                least = known(x, part.column("vec_id").to_numpy())
                near = np.argsort(half - np.hstack([x, np.zeros((len(x), 1))]) @ rotation @ centroids.T, axis=1, kind="stable")[:, :probes]
                to = [(i, c, s) for i, own in enumerate(near.tolist()) for c in own for s in range(per_list.get(c, 0))]
                row, lists, salt = (list(v) for v in zip(*to, strict=True)) if to else ([], [], [])
                take = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([take.column("vec_id"), take.column("v"), pa.array(least[row]), pa.array(lists, pa.int32()), pa.array(salt, pa.int32())], names=["query_id", "q", "least", "list", "salt"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), vectors.matrix(left.column("v"))
            q_ids, q, least = right.column("query_id").to_numpy(), vectors.matrix(right.column("q")), right.column("least").to_numpy()
            turned = lifted(x)
            for lo in range(0, len(q), 256):
                own = slice(lo, lo + 256)
                asking, asked_ids, bound = np.hstack([q[own], np.zeros((len(q[own]), 1))]) @ rotation, q_ids[own], least[own].copy()
                best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for at in range(0, len(x), ROWS):
                    far = (q[own] ** 2).sum(1) + most - 2 * bound
                    a, b = scan(turned[at : at + ROWS], asking, far)
                    b = b + at
                    other = ids[b] != asked_ids[a]
                    a, b = a[other], b[other]
                    a, b, score = (np.concatenate(v) for v in zip(best, (a, b, inner_products(x[b], q[own][a])), strict=True))
                    keep = vectors.best_rows(a, score, ids[b], k)
                    best = a[keep], b[keep], score[keep]
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(bound)) == k)
                    kth = np.full(len(bound), np.inf)
                    np.minimum.at(kth, best[0], best[2])
                    bound[full] = np.maximum(bound[full], kth[full])
                held.append((asked_ids[best[0]], ids[best[1]], best[2]))
        a, b, c = (np.concatenate(v) for v in zip(*held, strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64()), "sampled": pa.array(np.zeros(len(a), bool))})

    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int").alias("chunk")
    blocks = indexed.select("vec_id", "v", "list", vectors.salt_of(per_list).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sent = asked.select("vec_id", "v").mapInArrow(probe, "query_id long, q array<double>, least double, list int, salt int").select("query_id", "q", "least", "list", "salt", chunk("query_id"))
    keys = ("list", "salt", "chunk")
    found = blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(block, _FOUND)
    if n:
        found = found.union(asked.select("vec_id", "v").mapInArrow(from_sample, _FOUND))
    # A sampled row is met in its block too, if that is probed: the two are one row.
    rows_of = found.repartition("query_id").groupBy("query_id", "vec_id", "score").agg(F.greatest(F.count_if("sampled"), F.count_if(~F.col("sampled"))).alias("n"))
    return vectors.top(rows_of.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))), k)
