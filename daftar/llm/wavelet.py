"""Token files as wavelet matrices (operator 7).

Documents are range-partitioned by doc_id and cut into shards. A shard is one blob: the documents'
offsets and, for each bit of an id from the highest, a plane of bits of all tokens. A plane is compressed in blocks of BLOCK_BITS bits with a directory of
the blocks' places and of the ones before each, which serves rank and select. So one compressed file supports access to any token, counting of an id in a
range and the places of an id, and each of these opens one or two blocks a plane, not the file.

Spark writes the blobs as a Parquet table in the shared folder; nothing passes through the driver. A shard
holds about SHARD_TOKENS tokens (one longer document is a shard of its own).

Defined results: null and empty texts give the end id alone; a null doc_id sorts first; rows that share a doc_id
follow each other in the order of their text and each keep their row; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.bpe import BYTE_LETTERS
from daftar.llm.common import partitions, small_batches, text_slices, written
from daftar.llm.words import lower

SHARD_TOKENS = 1 << 21
_MAGIC = b"WVLT2\0"
#: Bits of a plane's block, and how many opened blocks a reader keeps.
BLOCK_BITS, KEPT = 1 << 15, 256
_MAX_PIECES = 800_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 65), *range(91, 97), *range(123, 127)]] = True


class WordEncoder:
    """Ids of whole texts, put together from the ids of their ASCII-white-space-separated pieces, which the library encodes once.

    The tokenizer must drop white space and treat each piece by itself, as word-end vocabularies do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(f.read())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[bytes, bytes] = {}

    @staticmethod
    def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        """Makes more pieces equal without a change of ids: A-Z lower-cased, and a space between an ASCII letter and an ASCII digit or mark, where the pre-tokenizer cuts anyway. Texts beside a possible special token stay as they are."""
        if b"<|" in data.tobytes():
            return data.tobytes(), offsets.tolist()
        data = lower(data)
        at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        return np.insert(data, at, 32).tobytes(), (offsets + np.searchsorted(at, offsets)).tolist()

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text, with the end id."""
        split = [t.split() for t in texts]
        rest, tokenize = [], self.tokenizer.model.tokenize
        for p in set().union(*split).difference(self.pieces):
            t = p.decode()
            # Small letters alone are one pre-token: the library's model takes it as it is.
            if t.isalpha() and (t.islower() if t.isascii() else t.lower() == t and unicodedata.is_normalized("NFC", t)):
                ids = [x.id for x in tokenize(t if t.isascii() else p.decode("latin-1").translate(BYTE_LETTERS))]
                self.pieces[p] = struct.pack(f"<{len(ids)}H", *ids)
            else:
                rest.append(p)
        for p, e in zip(rest, self.tokenizer.encode_batch([p.decode() for p in rest], add_special_tokens=False), strict=True):
            self.pieces[p] = struct.pack(f"<{len(e.ids)}H", *e.ids)
        last, get = struct.pack("<H", end), self.pieces.__getitem__
        out = [b"".join(map(get, s)) + last for s in split]
        if len(self.pieces) > _MAX_PIECES:
            self.pieces = {}
        return out


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def build(tokens: np.ndarray, starts: np.ndarray, bits: int = 16) -> bytes:
    """The blob of `tokens` (uint16); starts: where each document begins, and the end.

    Magic; number of tokens, documents, bits, bytes of offsets; per plane: zeros, bytes; then the offsets and the planes. A plane is its directory, the ones before each
    block and the end of each block as 32-bit integers, and its blocks.
    """
    press = zstandard.ZstdCompressor(level=1).compress
    offsets, planes, zeros, x = press(np.diff(starts, prepend=0).astype("<u4").tobytes()), [], [], tokens
    for b in range(bits - 1, -1, -1):
        bit = (x >> np.uint16(b) & np.uint16(1)).astype(bool)
        packed, size = np.packbits(bit), BLOCK_BITS // 8
        blocks = [packed[lo : lo + size] for lo in range(0, len(packed), size)]
        ones = np.cumsum([0, *(int(np.bitwise_count(p).sum()) for p in blocks)])[:-1]
        pressed = [press(p.tobytes()) for p in blocks]
        planes.append(ones.astype("<u4").tobytes() + np.cumsum([len(p) for p in pressed]).astype("<u4").tobytes() + b"".join(pressed))
        zeros.append(len(x) - int(np.count_nonzero(bit)))
        x = np.concatenate([x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))])  # faster than masks
    head = struct.pack("<QIIQ", len(tokens), len(starts) - 1, bits, len(offsets))
    return _MAGIC + head + np.array(zeros, "<u8").tobytes() + np.array([len(p) for p in planes], "<u8").tobytes() + offsets + b"".join(planes)


class Wavelet:
    """A shard's blob, opened. Blocks are decompressed when they are used; opened counts them."""

    def __init__(self, blob: bytes):
        if blob[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a token shard")
        at = len(_MAGIC)
        self.n, self.docs, self.bits, offsets = struct.unpack_from("<QIIQ", blob, at)
        at += struct.calcsize("<QIIQ")
        self.zeros = np.frombuffer(blob, "<u8", self.bits, at).astype(np.int64).tolist()
        sizes = np.frombuffer(blob, "<u8", self.bits, at + 8 * self.bits).astype(np.int64)
        self._offsets = at + 16 * self.bits, offsets
        self._blob, self.blocks, self.opened = blob, -(-self.n // BLOCK_BITS), 0
        begin = at + 16 * self.bits + offsets + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self._ones = [np.frombuffer(blob, "<u4", self.blocks, b) for b in begin.tolist()]
        self._ends = [np.frombuffer(blob, "<u4", self.blocks, b + 4 * self.blocks) for b in begin.tolist()]
        self._from = [b + 8 * self.blocks for b in begin.tolist()]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def starts(self) -> np.ndarray:
        at, size = self._offsets
        return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(self._blob[at : at + size]), "<u4").astype(np.int64))

    def _block(self, level: int, block: int) -> np.ndarray:
        """Packed bits of a block; those used last are kept."""
        key = level, block
        found = self._held.pop(key, None)
        if found is None:
            self.opened += 1
            lo, hi = int(self._ends[level][block - 1]) if block else 0, int(self._ends[level][block])
            found = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._blob[self._from[level] + lo : self._from[level] + hi]), np.uint8)
        self._held[key] = found
        if len(self._held) > KEPT:
            del self._held[next(iter(self._held))]
        return found

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i of a level."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, inside = divmod(i, BLOCK_BITS)
        packed = self._block(level, block)
        before = int(self._ones[level][block]) + int(np.bitwise_count(packed[: inside // 8]).sum())
        return before + (int(packed[inside // 8]) >> (8 - inside % 8)).bit_count() if inside % 8 else before

    def bit(self, level: int, i: int) -> int:
        block, inside = divmod(i, BLOCK_BITS)
        return int(self._block(level, block)[inside // 8]) >> (7 - inside % 8) & 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            b = self.bit(level, i)
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if b else i - ones
            token = token << 1 | b
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in tokens lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) `bit` of a level: its block by the directory, its place inside by the block's bits."""
        before = self._ones[level].astype(np.int64)
        if not bit:
            before = np.arange(self.blocks) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - before[block]])

    def places(self, token: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """Where an id stands in tokens lo to hi, in order."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        out = []
        for at in range(a, b):
            for level in range(self.bits - 1, -1, -1):
                one = token >> (self.bits - 1 - level) & 1
                at = self._select(level, one, at - self.zeros[level] if one else at)
            out.append(at)
        return out

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the levels from the last."""
        order = None
        for level in range(self.bits - 1, -1, -1):
            packed = np.concatenate([np.zeros(0, np.uint8), *(self._block(level, b) for b in range(self.blocks))])
            bit = np.unpackbits(packed, count=self.n).astype(bool)
            b = bit.astype(np.uint16) << np.uint16(self.bits - 1 - level)
            if order is not None:
                below = np.empty(self.n, np.uint16)
                below[np.flatnonzero(~bit)], below[np.flatnonzero(bit)] = order[: self.zeros[level]], order[self.zeros[level] :]
                b |= below
            order = b
        return order if order is not None else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes docs (doc_id long, text) into token files in ascending doc_id order; returns the files' table: part, shard, doc_ids, n_tokens, blob."""

    def shard(part: int, number: int, ids: list, held: list[bytes]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in held])])
        blob = build(np.frombuffer(b"".join(held), "<u2"), starts)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, number, ids, int(starts[-1]), blob), kinds, strict=True)], names=["part", "shard", "doc_ids", "n_tokens", "blob"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, ids, held, size, number, part = word_encoder(tokenizer_path), [], [], 0, 0, -1
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                part = rows.column("part")[0].as_py()
                whole, at = e.prepared(data, offsets)
                for i, x in zip(rows.column("doc_id").to_pylist(), e.encode([whole[a:b] for a, b in zip(at, at[1:], strict=False)], end_id), strict=True):
                    if held and size + len(x) // 2 > shard_tokens:
                        yield shard(part, number, ids, held)
                        ids, held, size, number = [], [], 0, number + 1
                    ids.append(i)
                    held.append(x)
                    size += len(x) // 2
        if held:
            yield shard(part, number, ids, held)

    n = partitions(docs.sparkSession)
    dealt = small_batches(docs).select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return written(dealt.mapInArrow(run, "part int, shard int, doc_ids array<bigint>, n_tokens long, blob binary"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("shard_start"))
    base = inside.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, ids, blob in zip(*(batch.column(c) for c in ("part", "shard", "doc_ids", "blob")), strict=True):
                w = Wavelet(blob.as_py())
                tokens, starts = w.tokens().astype("<u4"), w.starts().tolist()
                n = len(starts) - 1
                sums = [zlib.crc32(tokens[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), pa.array(ids.as_py(), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "doc_ids", "blob").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
