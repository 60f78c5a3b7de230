"""Exact top-k search by integer inner product with dual cover trees (operator 9).

Rows are dealt into blocks of bounded size that lie close together (pivots from a bounded sample, a salt from the counts), queries into chunks.
A query's kth score in the sample is a true lower bound: it goes only to the blocks where their list's radius around the pivot allows a score that
reaches it. Each task meets one block with one chunk: it builds a cover tree of either and walks both together, dropping a pair of
nodes when the largest inner product that their covering radii allow is below the worst kth score of the query
node's group, which begins at the bound. Ties are never dropped. The k best of all blocks are then ranked per query, so the result is exact.

Defined results: vectors null, empty, with null or non-finite components, or without an id take no part; so do those of another
length than the most frequent, which have no inner product with the rest; zero vectors take part; every row but those with the query's own id is a candidate,
so an id that stands in several rows may take several places; an id queried twice is one query (its least vector); components of any size are
exact, and a score that a long can't hold raises an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import vectors
from daftar.llm.common import written

SCALE = 1024
PIVOT_SAMPLE, MOST_PIVOTS, LEAF = 2048, 256, 64
_FOUND = "query_id long, vec_id long, score long"


class Node:
    """center: row number of the node's point; radius: covers all its points; points: those held here; children: nodes below."""

    __slots__ = ("center", "children", "points", "radius")

    def __init__(self, center: int, radius: float, points: np.ndarray, children: list[Node]):
        self.center, self.radius, self.points, self.children = center, radius, points, children


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree: each level's centres lie within half the radius above of all their points. Points that no other is near stay with their parent."""
    rows = np.arange(len(x)) if rows is None else rows
    center = int(rows[0])
    dist = np.sqrt(((x[rows] - x[center]) ** 2).sum(1))
    radius = float(dist.max())
    if len(rows) <= leaf or radius == 0:
        return Node(center, radius, rows, [])
    children, loose, left, d = [], [], rows, dist
    while len(left):
        near = d <= radius / 2
        inside = left[near]
        if len(inside) <= max(1, leaf // 8):
            loose.append(inside)
        else:
            children.append(cover_tree(x, inside, leaf))
        left = left[~near]
        if len(loose) >= 32 and sum(map(len, loose)) > 8 * len(children) * leaf:  # spread too evenly to cover further
            loose.append(left)
            break
        if len(left):
            d = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1))
    points = np.concatenate(loose) if loose else np.zeros(0, np.int64)
    return Node(center, radius, points, children)


_LOWEST = np.iinfo(np.int64).min


def _whole(m: np.ndarray) -> np.ndarray:
    """A matrix of integral doubles as Python's integers, of any size."""
    return np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)


class DualSearch:
    """Top-k of all queries q in all rows x (matrices of integral doubles); least: a lower bound of each query's kth score, where one is known."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.fx, self.fq, self.ids, self.q_ids, self.k = x.astype(float), q.astype(float), ids, q_ids, k
        top = max((float(np.abs(m).max()) for m in (x, q) if m.size), default=0.0)
        size = top * top * x.shape[1]
        self.exact = size < 2**53  # then double precision holds every score exactly
        if not self.exact:
            kind = (lambda m: m.astype(np.int64)) if size < 2**62 else _whole
            self.x, self.q = kind(self.fx), kind(self.fq)
        self.norm = np.sqrt((self.fx**2).sum(1))
        self.worst = np.full(len(q), _LOWEST) if least is None else least.copy()
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.visited = 0

    def scores(self, queries: np.ndarray, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """As longs; where other is false, anything."""
        if self.exact:
            return (self.fq[queries] @ self.fx[rows].T).astype(np.int64)
        return np.where(other, self.q[queries] @ self.x[rows].T, 0).astype(np.int64)

    def base(self, queries: np.ndarray, rows: np.ndarray) -> None:
        self.visited += len(queries) * len(rows)
        other = self.ids[rows][None] != self.q_ids[queries][:, None]
        s = self.scores(queries, rows, other)
        ok = (s >= self.worst[queries][:, None]) & other
        a, b = np.nonzero(ok)
        q, r, v = (np.concatenate(p) for p in zip(self.held, (queries[a], rows[b], s[a, b]), strict=True))
        keep = vectors.best_rows(q, v, self.ids[r], self.k)
        self.held = q[keep], r[keep], v[keep]
        number, count = np.unique(self.held[0], return_counts=True)
        full = number[count == self.k]
        if len(full):
            least = np.full(len(self.worst), np.iinfo(np.int64).max)
            np.minimum.at(least, self.held[0], self.held[2])
            self.worst[full] = np.maximum(self.worst[full], least[full])

    def bound(self, group: Node, nodes: list[Node]) -> np.ndarray:
        centers, radii = np.array([n.center for n in nodes]), np.array([n.radius for n in nodes])
        c = self.fq[group.center]
        b = self.fx[centers] @ c + group.radius * self.norm[centers] + radii * np.sqrt((c**2).sum()) + group.radius * radii
        return b + 1e-9 * np.abs(b) + 1e-6

    def members(self, group: Node) -> np.ndarray:
        return np.concatenate([group.points, *(self.members(c) for c in group.children)]).astype(np.int64)

    def walk(self, group: Node, nodes: list[Node]) -> None:
        """All of the group's queries against all that lies below the nodes."""
        queries = self.members(group)
        b = self.bound(group, nodes)
        order = np.argsort(-b, kind="stable")
        for i in order.tolist():
            node = nodes[i]
            if b[i] < self.worst[queries].min():
                break
            if group.children and node.children:
                for child in group.children:
                    self.walk(child, [node])
                if len(group.points):
                    self.walk(Node(group.center, group.radius, group.points, []), [node])
                continue
            if len(node.points):
                for lo in range(0, len(node.points), 1024):
                    self.base(queries, node.points[lo : lo + 1024])
            if node.children:
                self.walk(group, node.children)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for lo in range(0, len(self.fq), 256):
            part = np.arange(lo, min(lo + 256, len(self.fq)))
            done = self.held
            self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            tree = cover_tree(self.fq, part)
            if lo == 0:
                self.data = cover_tree(self.fx)
            self.walk(tree, [self.data])
            self.held = tuple(np.concatenate(p) for p in zip(done, self.held, strict=True))
        q, r, v = self.held
        return self.q_ids[q], self.ids[r], v


def search(rows: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score. A row with the query's own id is not its candidate."""
    whole = lambda df: vectors.usable(df, id_col, vector_col, allow_zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    data = whole(rows)
    asked = whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = data.count()
    some_ids, some = vectors.sample(data, PIVOT_SAMPLE) if n else (np.zeros(0, np.int64), np.zeros((0, 1)))
    pivots = some[: max(1, min(MOST_PIVOTS, n // vectors.BLOCK_ROWS))] if n else np.zeros((1, 1))
    half = 0.5 * (pivots**2).sum(1)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, vectors.BLOCK_ROWS):
                part = b.slice(lo, vectors.BLOCK_ROWS)
                x = vectors.matrix(part.column("v"))
                near = np.argmax(x @ pivots.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(near, pa.int32()), pa.array(np.sqrt(((x - pivots[near]) ** 2).sum(1)))], names=["vec_id", "v", "list", "far"])

    dealt = written(data.mapInArrow(deal, "vec_id long, v array<double>, list int, far double"))
    held = dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # one row a pivot, MOST_PIVOTS at most
    per_list = {r["list"]: -(-r["n"] // vectors.BLOCK_ROWS) for r in held}
    radius = np.array([next((r["radius"] for r in held if r["list"] == i), -np.inf) for i in range(len(pivots))])
    chunks = vectors.chunks_of(asked.count())

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the blocks that may hold one of its k best."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x, own = vectors.matrix(part.column("v")), part.column("vec_id").to_numpy()
                least = np.full(len(x), -np.inf)
                if len(some) > k:
                    score = np.where(own[:, None] == some_ids[None], -np.inf, x @ some.T)
                    least = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
                    least = np.floor(least - 1e-9 * np.abs(least))  # whatever rounding does, a lower bound
                most = x @ pivots.T + np.sqrt((x**2).sum(1))[:, None] * radius[None]
                to = [(i, c, s) for i, c in zip(*np.nonzero(most + 1e-9 * np.abs(most) + 1 >= least[:, None]), strict=True) for s in range(per_list.get(int(c), 0))]
                row, lists, salt = (list(map(int, v)) for v in zip(*to, strict=True)) if to else ([], [], [])
                take = part.take(pa.array(row, pa.int64()))
                known = np.where(least > _LOWEST / 2, np.maximum(least, _LOWEST / 2), 0).astype(np.int64)
                known[least <= _LOWEST / 2] = _LOWEST
                yield pa.RecordBatch.from_arrays([take.column("vec_id"), take.column("v"), pa.array(known[row]), pa.array(lists, pa.int32()), pa.array(salt, pa.int32())], names=["query_id", "q", "least", "list", "salt"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            found = DualSearch(vectors.matrix(left.column("v")), left.column("vec_id").to_numpy(), vectors.matrix(right.column("q")), right.column("query_id").to_numpy(), k, right.column("least").to_numpy()).run()
        else:
            found = (np.zeros(0, np.int64),) * 3
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found, strict=True)})

    blocks = dealt.select("vec_id", "v", "list", vectors.salt_of(per_list).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sent = asked.select("vec_id", "v").mapInArrow(send, "query_id long, q array<double>, least long, list int, salt int").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    keys = ("list", "salt", "chunk")
    return vectors.top(blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(block, _FOUND), k)
