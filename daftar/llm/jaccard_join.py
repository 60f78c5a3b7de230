"""Set similarity join on word n-grams with skipping by set relations (operator 3).

A text's set is its distinct shingles, as 64-bit hashes. Equal sets are one node. Tokens have one global order: frequent ones (a Bloom filter of bounded size
that is fitted on counts over all texts) last, then by hash. Two similar sets share a token in their prefixes, so only prefixes are indexed.

Index-level skipping: an entry carries its place in its set; a list is read in blocks by set size and place, and a
block is skipped when the sizes, or what can still follow those places, rule out the needed overlap.

Answer-level skipping: in a long list all sets are first compared with one leader, the set in which the list's token comes first (the
most typical one); lists with one leader are one group. What a set shares with its leader then answers for the others: sets already linked through it are not compared again, and the overlap of
two others is bounded by their overlaps with the leader and by bitmaps of their differences from it; only pairs that these bounds leave open are compared. So a group of near copies costs
about one comparison per set, and no link that joins different components is lost. The answer is components, not links: pairs inside
a leader's component are not compared, so links and their number per document don't come out.

Entries travel packed by token bucket (see matching): equal sets of one slice of texts send one entry.

Defined results: null and empty texts, and texts without words, have an empty set and component of their own; fewer words than a shingle are one token; repeated rows
and ids keep their rows; rows without an id link nothing and have no component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm import bloom
from daftar.llm.common import buckets_for, discard, release, small_batches, text_slices, written
from daftar.llm.components import components
from daftar.llm.words import lower, mix, run_hashes, spans, word_hashes

#: Lists up to SMALL are compared in full. A token is frequent from HOT prefixes on. FILTER_BITS bounds the filter of frequent tokens.
SMALL, HOT, FILTER_BITS = 8, 12, 1 << 24
_SLICE = 1 << 20
_POSTING = np.dtype([("t", "<u4"), ("s", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in the order of texts and then of hashes: (tokens, first token of each text and the end)."""
    data = lower(data)
    starts, ends, first = spans(data, offsets)
    words = word_hashes(data, starts, ends)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    full = at + width <= first[1:][doc]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    shorter = [(k, short[sizes[short] == k]) for k in range(1, width)]
    tokens = np.concatenate([run_hashes(words, at[full], width), *(run_hashes(words, first[i], k) for k, i in shorter)])
    owner = np.concatenate([doc[full], *(i for _, i in shorter)])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
        tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(sizes) + 1))


def fingerprints(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as a node; 0 for the empty set."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    n = np.diff(first)
    h = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, h, 0).astype(np.uint64).view(np.int64)


def needed(n, m, percent: int):
    """The least overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _prefix(tokens: np.ndarray, first: np.ndarray, percent: int, filled: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, place) of the prefixes of the given rows in the global order."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    some = np.zeros(len(n), bool)
    some[rows] = True
    at = some[owner]
    tokens, owner = tokens[at], owner[at]
    if filled is not None:
        often = bloom.maybe(filled, tokens >> np.uint64(32))
        order = np.lexsort((tokens, often, owner))
        tokens, owner = tokens[order], owner[order]
    begin = np.searchsorted(owner, np.arange(len(n)))
    pos = np.arange(len(owner)) - begin[owner]
    length = n + (-percent * n // 100) + 1  # n - ceil(percent * n / 100) + 1
    keep = pos < length[owner]
    return owner[keep], tokens[keep], pos[keep]


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _dealt(t: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    at = (t % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _scan(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Per document its columns but text, n and s, and packed counts of tokens in prefixes by hash (bucket, blob)."""
    named = [c for c in docs.columns if c != "text"]
    columns = [*named, "n", "s", "bucket", "blob"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", _SLICE):
                tokens, first = sets_of(data, offsets, width)
                s, n = fingerprints(tokens, first), np.diff(first)
                k = rows.num_rows
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in named), pa.array(n, pa.int64()), pa.array(s), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=columns)
                t = _prefix(tokens, first, percent, None, np.unique(s, return_index=True)[1])[1]
                t, count = np.unique(t, return_counts=True)
                dealt = [(b, _pack((t[i] >> np.uint64(32)).astype("<u4"), np.minimum(count[i], 255).astype("<u1"))) for b, i in _dealt(t, buckets)]  # half a hash will do, as order only
                k = len(dealt)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in columns[:-2]), pa.array([b for b, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names=columns)

    return docs.mapInArrow(run, "".join(f"{c} long, " for c in columns[:-2]) + "bucket int, blob binary")


def _frequent(counts: DataFrame) -> np.ndarray:
    """The filter of tokens that stand in HOT prefixes or more: FILTER_BITS bits, whatever the input."""

    def count(table: pa.Table) -> pa.Table:
        release()
        raw = [zstandard.ZstdDecompressor().decompress(b) for b in table.column("blob").to_pylist()]
        t = np.concatenate([np.frombuffer(r[: len(r) // 5 * 4], "<u4") for r in raw])
        n = np.concatenate([np.frombuffer(r[len(r) // 5 * 4 :], "<u1") for r in raw])
        t, inverse = np.unique(t, return_inverse=True)
        return bloom.masks(t[np.bincount(inverse, n) >= HOT].astype(np.uint64), FILTER_BITS)

    return bloom.gathered(counts.groupBy("bucket").applyInArrow(count, "block long, mask long"), FILTER_BITS)


def _postings(docs: DataFrame, width: int, percent: int, buckets: int, filled: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text", _SLICE):
                tokens, first = sets_of(data, offsets, width)
                s, n = fingerprints(tokens, first), np.diff(first)
                row, t, pos = _prefix(tokens, first, percent, shared.value, np.unique(s, return_index=True)[1])
                dealt = [(b, _pack((t[i] >> np.uint64(32)).astype("<u4"), s[row[i]], n[row[i]].astype("<i4"), pos[i].astype("<i4"))) for b, i in _dealt(t, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names=["bucket", "blob"])

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // _POSTING.itemsize, 0
    out = np.empty(n, _POSTING)
    for c in _POSTING.names:
        size = _POSTING[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], _POSTING[c])
        at += size
    return out


def fits(n, m, i, j, percent: int):
    """Whether sets of n and m tokens that share the tokens at places i and j, none before, can be similar."""
    return np.minimum(n - i, m - j) >= needed(n, m, percent)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) to compare, b the leader in a long list; and with n the members a of long lists, their size n and the list's leader b."""

    def lists(table: pa.Table) -> pa.Table:
        release()
        e = np.concatenate([_unpack(b) for b in table.column("blob").to_pylist()])
        e = e[np.lexsort((e["s"], e["pos"], e["t"]))]
        e = e[np.r_[True, (e["t"][1:] != e["t"][:-1]) | (e["s"][1:] != e["s"][:-1])]]
        first = np.flatnonzero(np.r_[True, e["t"][1:] != e["t"][:-1]])
        size = np.diff(np.r_[first, len(e)])
        pairs = []
        for gap in range(1, SMALL):  # the entries `gap` apart of all short lists at once
            own = (size <= SMALL) & (size > gap)
            i = np.concatenate([first[own] + k for k in range(SMALL - gap)]) if own.any() else np.zeros(0, np.int64)
            end = np.tile((first + size)[own], SMALL - gap)
            i = i[i + gap < end]
            pairs.append((i, i + gap))
        long = size > SMALL
        inside = np.repeat(long, size)
        leader = np.repeat(first, size)
        member = np.flatnonzero(inside & (np.arange(len(e)) != leader))
        pairs.append((member, leader[member]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        ok = inside[a] | fits(e["n"][a].astype(np.int64), e["n"][b].astype(np.int64), e["pos"][a], e["pos"][b], percent)
        found = np.unique(np.stack([e["s"][a[ok]], e["s"][b[ok]]], 1), axis=0)
        every = np.flatnonzero(inside)
        group = np.unique(np.stack([e["s"][every], e["s"][leader[every]], e["n"][every].astype(np.int64)], 1), axis=0)
        k = len(found)
        return pa.table({"a": pa.array(np.r_[found[:, 0], group[:, 0]]), "b": pa.array(np.r_[found[:, 1], group[:, 1]]), "n": pa.array(np.r_[np.zeros(k, np.int64), group[:, 2]], mask=np.r_[np.ones(k, bool), np.zeros(len(group), bool)])})

    return postings.groupBy("bucket").applyInArrow(lists, "a long, b long, n long")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(s, tokens) of the given nodes (s, doc_id of one text of each) and of few others, tokens as sorted packed hashes of 48 bits. Texts stay where they are read: a filter of the ids picks them."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.of_column(nodes, "doc_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bloom.maybe(shared.value, batch.column("doc_id").to_numpy())))
            for _, data, offsets in text_slices(some, "text", _SLICE):
                tokens, first = sets_of(data, offsets, width)
                packed = (tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                at = first.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(tokens, first)), pa.array([packed[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["s", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "s long, tokens binary")


def _unpacked(tokens: memoryview) -> np.ndarray:
    raw = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


#: Longs of a bitmap; sets of a block of a long list; leaders of each set by which pairs that several lists hold are told once.
_LONGS, _BLOCK, _KNOWN = 16, 1024, 16
_BITS = [f"{sign}{i}" for sign in ("lack", "more") for i in range(_LONGS)]
_MEASURED = ["a", "b", "n_a", "n_b", "overlap", *_BITS, "lack_extra", "more_extra"]


def _bitmap(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits in _LONGS longs, one set for each token, and how many tokens have no bit of their own."""
    flags = np.zeros(64 * _LONGS, bool)
    flags[(tokens % np.uint64(64 * _LONGS)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<i8"), len(tokens) - int(np.count_nonzero(flags))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b, overlap, and bitmaps of what a lacks of b and has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(_MEASURED) - 2), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit = y[at] == x
                common = np.zeros(len(y), bool)
                common[at[hit]] = True
                lack, more = _bitmap(y[~common]), _bitmap(x[~hit])
                out[i] = [len(x), len(y), np.count_nonzero(hit), *lack[0], *more[0], lack[1], more[1]]
            release()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=_MEASURED)

    sets = sets.dropDuplicates(["s"])  # of equal sets that passed the filter one is enough
    x = sets.select(F.col("s").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("s").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, ", ".join(f"{c} long" for c in _MEASURED))


def _left_open(named: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Pairs (a, b) of one leader's list, of different components, that the bounds don't exclude.

    A list is dealt by hash into blocks of about _BLOCK sets, and each pair of blocks is one group, so no task holds more than two blocks. A pair that two lists
    hold is told in the one whose leader comes first among those of the _KNOWN first leaders of both. The rows are few bytes for much work, so their partitions are
    numbered and not merged by size.
    """
    at = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    spread = named.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = spread.withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")}).drop("other", "blocks", "leader_root")

    def run(table: pa.Table) -> pa.Table:
        release()
        c = {k: table.column(k).to_numpy() for k in ("s", "root", "n", "with", "n_leader", "lack_extra", "more_extra", "at")}
        bits = {sign: np.stack([table.column(f"{sign}{k}").to_numpy() for k in range(_LONGS)], 1) for sign in ("lack", "more")}
        size = {"lack": c["n_leader"] - c["with"], "more": c["n"] - c["with"]}
        lists = table.column("leaders").combine_chunks()
        leaders = np.full((len(c["s"]), _KNOWN), np.iinfo(np.int64).max)
        ends = lists.offsets.to_numpy()
        leaders[np.arange(_KNOWN) < np.diff(ends)[:, None]] = lists.values.to_numpy()[ends[0] : ends[-1]]
        leader, i, j = (table.column(k)[0].as_py() for k in ("leader", "i", "j"))
        left, right = np.flatnonzero(c["at"] == i), np.flatnonzero(c["at"] == j)
        found = []

        def both(sign: str, x: np.ndarray, y: np.ndarray, met) -> np.ndarray:
            """At most so many tokens that both lack of the leader, or have beside it."""
            return np.minimum(met + np.minimum(c[f"{sign}_extra"][x], c[f"{sign}_extra"][y]), np.minimum(size[sign][x], size[sign][y]))

        for k in range(0, len(left), 64):
            x, y = (v.ravel() for v in np.meshgrid(left[k : k + 64], right, indexing="ij"))
            least = needed(c["n"][x], c["n"][y], percent)
            rest = c["n_leader"][x] - size["lack"][x] - size["lack"][y]
            ok = (c["root"][x] != c["root"][y]) & (np.minimum(c["n"][x], c["n"][y]) >= least)
            ok &= rest + np.minimum(size["lack"][x], size["lack"][y]) + np.minimum(size["more"][x], size["more"][y]) >= least
            if i == j:
                ok &= x < y
            x, y, least, rest = x[ok], y[ok], least[ok], rest[ok]
            lack, more = (both(sign, x, y, np.bitwise_count(bits[sign][x] & bits[sign][y]).sum(1, dtype=np.int64)) for sign in ("lack", "more"))
            ok = rest + lack + more >= least
            x, y = x[ok], y[ok]
            before = np.zeros(len(x), bool)
            for n in range(_KNOWN):
                own = leaders[x, n]
                before |= (own < leader) & (leaders[y] == own[:, None]).any(1)
            x, y = c["s"][x[~before]], c["s"][y[~before]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return groups.repartition(buckets, "leader", "i", "j").groupBy("leader", "i", "j").applyInArrow(run, "a long, b long")


def _least(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent) - F.lit(1e-9))


def join(docs: DataFrame, width: int = 5, percent: int = 80, text_hash: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. width: words of a shingle; percent: the least Jaccard similarity of a link.

    text_hash: two more columns: text_hash, xxhash64 of the text, by which rows with one id can be told apart, and component, a number that the rows of one component share (rows without one: null).
    """
    own_hash = ["text_hash"] if text_hash else []
    docs = small_batches(docs).select("doc_id", "text", *(F.xxhash64("text").alias(c) for c in own_hash))
    buckets = buckets_for(docs)
    scanned = written(_scan(docs, width, percent, buckets))
    rows = scanned.where("bucket is null").select("doc_id", *own_hash, "n", "s")
    filled = _frequent(scanned.where("bucket is not null").select("bucket", "blob"))
    known = docs.where("doc_id is not null")
    found = written(_candidates(_postings(known, width, percent, buckets, filled), percent))
    first = found.where("n is null").select("a", "b").distinct()
    entries = found.where("n is not null").select(F.col("a").alias("s"), F.col("b").alias("leader"), "n").distinct()
    classes = rows.where("doc_id is not null and n > 0").groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.select(F.col("a").alias("s")).union(first.select("b")).union(entries.select("s")).distinct()
    sets = written(_sets(known, wanted.join(classes, "s"), width))
    measured = written(_overlaps(first, sets))
    similar = F.col("overlap") >= _least(F.col("n_a"), F.col("n_b"), percent)
    links = measured.where(similar).select("a", "b")
    roots = components(links)
    # What is left: of the sets that meet a leader, those that its component doesn't hold against those of other components.
    named = entries.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    named = named.join(roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root")), "leader", "left").withColumn("leader_root", F.coalesce("leader_root", "leader"))
    shared = measured.select(F.col("a").alias("s"), F.col("b").alias("leader"), F.col("overlap").alias("with"), F.col("n_b").alias("n_leader"), *_BITS, "lack_extra", "more_extra")
    own = F.col("s") == F.col("leader")
    named = named.join(shared, ["s", "leader"], "left").withColumns({"with": F.when(own, F.col("n")).otherwise(F.col("with")), "n_leader": F.when(own, F.col("n")).otherwise(F.col("n_leader")), **{c: F.coalesce(c, F.when(own, F.lit(0).cast("long"))) for c in (*_BITS, "lack_extra", "more_extra")}})
    first_of = Window.partitionBy("s").orderBy("leader")
    others = entries.select("s", "leader").withColumn("k", F.row_number().over(first_of)).where(F.col("k") <= _KNOWN).groupBy("s").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
    blocks = entries.groupBy("leader").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    named = written(named.join(others, "s").join(blocks, "leader"))
    second = _left_open(named, percent, buckets).distinct()
    more = _overlaps(second, sets).where(similar).select("a", "b")
    roots = components(links.union(more))
    discard(found, sets, measured, named)
    labels = classes.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    least_of = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(labels.join(least_of, "root").select("s", "root", "component_id"), "s", "left")
    has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    own = [F.col(c) for c in own_hash] + [F.when(has, F.col("root")).alias("component") for _ in own_hash]
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has | (F.col("n") > 0), F.when(has, F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"), *own)
