"""Byte-level BPE encoding and decoding with content-defined chunk reuse (operator 5).

A rolling hash over the bytes cuts every text into chunks, so that texts which share a passage share
its chunks. A chunk is encoded once while a task keeps it: its memory holds CHUNK_BYTES of ids and edges, those used last. A chunk keeps the ids
between its first and its last boundary, a place where ASCII white space follows another byte. Joins are repaired by encoding again: what is left at
either end of a join goes to the library together with the last piece of the chunk before and the first of the chunk after, and the ids of these two
must come out as the chunks have them. Where they don't, the join reaches over further pieces, REACH on either side at most, and then
over the whole text; so the ids agree with those of the whole text.

No shuffle: a task holds one slice of texts. Chunks are shared between the texts of a task, not between tasks.

Defined results: null and empty texts have no ids; rows are kept one for one, so repeated rows and ids
repeat; a text with white space outside ASCII is encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from daftar.llm.common import small_batches, text_slices

_PIECE = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_SPACE = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BOUNDARY = re.compile(rb"[^ \t-\r](?=[ \t-\r])")
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, np.uint32)
_CHUNK_BITS = 10
#: Pieces between white space that a task keeps, bytes of its chunks, and pieces of a chunk kept on either side of a join.
_MAX_PIECES, CHUNK_BYTES, REACH = 100_000, 16 << 20, 2
#: Strings that the library gets at once: its results are larger than their ids.
_BATCH = 500


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else the next character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = _byte_letters()


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_points(data: np.ndarray, bits: int = _CHUNK_BITS) -> np.ndarray:
    """Where chunks end: places after which the gear hash of the last 32 bytes has `bits` zero bits."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


@dataclass(slots=True)
class Chunk:
    """head and tail: what stands before the first and after the last boundary; ids of what is between, None if only the whole text's count; the first and last REACH pieces there with their ids."""

    head: bytes
    tail: bytes
    ids: bytes | None
    first: list[tuple[bytes, bytes]]
    last: list[tuple[bytes, bytes]]


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers, in bytes. found and missed count chunks, repaired the joins that needed more than the pieces beside them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(f.read())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[bytes, bytes | None] = {}
        self.chunks: OrderedDict[bytes, Chunk | None] = OrderedDict()
        self.size = self.found = self.missed = self.repaired = 0

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each, by the library."""
        for lo in range(0, len(texts), _BATCH):
            for e in self.tokenizer.encode_batch(texts[lo : lo + _BATCH], add_special_tokens=False):
                yield pack(e.ids)

    def _learn(self, pieces: set[bytes]) -> None:
        rest, tokenize = [], self.tokenizer.model.tokenize
        for p in pieces.difference(self.pieces):
            t = p.decode()
            if (t[1:] if t[0] == " " else t).isalpha():  # letters after a space or none are one pre-token, which the library's model takes as it is
                self.pieces[p] = pack([x.id for x in tokenize(p.decode("latin-1").translate(BYTE_LETTERS))])
            else:
                rest.append(t)
        for t, ids in zip(rest, self._encoded(rest), strict=True):
            self.pieces[t.encode()] = None if not t.isascii() and _ODD_SPACE.search(t) else ids

    @staticmethod
    def _split(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """Head, body between the outer boundaries, tail; None without a boundary."""
        first = _BOUNDARY.search(chunk)
        if first is None:
            return None
        head, last = first.end(), len(chunk.rstrip())
        if last == len(chunk):  # the last boundary is before the last word
            last = len(chunk[: len(chunk) - len(chunk.rsplit(None, 1)[1])].rstrip())
        return chunk[:head], chunk[head:last], chunk[last:]

    @staticmethod
    def _weight(chunk: Chunk | None) -> int:
        """Bytes that an entry takes, about, with its key and its pieces."""
        return 250 if chunk is None else 1000 + len(chunk.head) + len(chunk.tail) + len(chunk.ids or b"")

    def _remember(self, key: bytes, chunk: Chunk | None) -> None:
        self.chunks[key] = chunk
        self.size += self._weight(chunk)
        while self.size > CHUNK_BYTES:
            self.size -= self._weight(self.chunks.popitem(last=False)[1])

    def _chunks_of(self, texts: list[bytes]) -> list[list[tuple[bytes, Chunk | None]] | None]:
        """Each text's chunks; None for a text with separators that only some readers take for white space."""
        cut, split, need = [], {}, set()
        for text in texts:
            data = np.frombuffer(text, np.uint8)
            if (data - np.uint8(0x1C) < 4).any():
                cut.append(None)
                continue
            cuts = [0, *(c for c in cut_points(data).tolist() if c < len(text)), len(text)] if text else [0]
            parts = [text[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
            keys = [xxhash.xxh3_128_digest(p) for p in parts]
            for key, part in zip(keys, parts, strict=True):
                if key in self.chunks or key in split:
                    self.found += 1
                    continue
                self.missed += 1
                own = self._split(part)
                body = _PIECE.findall(own[1]) if own else []
                need.update(body)
                split[key] = own and (own[0], own[2], body)
            cut.append(list(zip(keys, parts, strict=True)))
        self._learn(need)
        known: dict[bytes, Chunk | None] = {}
        for key, own in split.items():
            ids = [self.pieces[p] for p in own[2]] if own else []
            odd = None in ids
            pieces = [] if odd else list(zip(own[2], ids, strict=True)) if own else []
            known[key] = own and Chunk(own[0], own[1], None if odd else b"".join(ids), pieces[:REACH], pieces[-REACH:])
        for keys in cut:
            for key, _ in keys or ():
                if key in self.chunks:
                    known.setdefault(key, self.chunks[key])
                    self.chunks.move_to_end(key)
        for key in split:
            self._remember(key, known[key])
        return [keys and [(part, known[key]) for key, part in keys] if keys is not None else None for keys in cut]

    def _joined(self, joins: list[tuple[Chunk | None, bytes, Chunk | None]], reach: int) -> list[bytes | None]:
        """Ids of what stands between two chunks, encoded with `reach` pieces of either; None where the ids of those don't come out as the chunks have them."""
        befores = [b.last[-reach:] if b else [] for b, _, _ in joins]
        afters = [a.first[:reach] if a else [] for _, _, a in joins]
        texts = [b"".join([*(p for p, _ in x), middle, *(p for p, _ in y)]).decode() for x, (_, middle, _), y in zip(befores, joins, afters, strict=True)]
        out = []
        for t, ids, x, y in zip(texts, self._encoded(texts), befores, afters, strict=True):
            left, right = b"".join(i for _, i in x), b"".join(i for _, i in y)
            agree = ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right) and (t.isascii() or not _ODD_SPACE.search(t))
            out.append(ids[len(left) : len(ids) - len(right)] if agree else None)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        plans, joins = [], []
        for chunks in self._chunks_of(texts):
            if chunks is None or any(c is not None and c.ids is None for _, c in chunks):
                plans.append(None)
                continue
            plan, carry, before = [], b"", None
            for part, chunk in chunks:
                if chunk is None:
                    carry += part
                    continue
                joins.append((before, carry + chunk.head, chunk))
                plan += [len(joins) - 1, chunk.ids]
                carry, before = chunk.tail, chunk
            if carry:
                joins.append((before, carry, None))
                plan.append(len(joins) - 1)
            plans.append(plan)
        found = self._joined(joins, 1)
        for reach in range(2, REACH + 1):
            open_ = [i for i, f in enumerate(found) if f is None]
            self.repaired += len(open_)
            for i, f in zip(open_, self._joined([joins[i] for i in open_], reach), strict=True):
                found[i] = f
        out = []
        for text, plan in zip(texts, plans, strict=True):
            ids = None if plan is None else [found[x] if isinstance(x, int) else x for x in plan]
            out.append(self.whole(text.decode()) if ids is None or None in ids else b"".join(ids))
        if len(self.pieces) > _MAX_PIECES:
            self.pieces = {}
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; the printable stand-ins of a byte-level vocabulary are turned back."""
    back = {c: b for b, c in BYTE_LETTERS.items()}
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    out = [b""] * (1 + max([*d["model"]["vocab"].values(), *(a["id"] for a in d["added_tokens"])]))
    for token, i in d["model"]["vocab"].items():
        out[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
    for a in d["added_tokens"]:
        out[a["id"]] = a["content"].encode()
    return out


def decode(path: str, ids: bytes) -> str:
    table = token_bytes(path)
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids (little-endian unsigned 32-bit integers, binary), n_tokens long, decoded string."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "__text"):
                whole, at = data.tobytes(), offsets.tolist()
                ids = e.encode([whole[a:b] for a, b in zip(at, at[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([decode(tokenizer_path, x) for x in ids], pa.string())], names=[id_col, "ids", "n_tokens", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_documents with the two long columns as SHA-256 digests, made in the same task so that neither leaves it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "__text"):
                whole, at = data.tobytes(), offsets.tolist()
                ids = e.encode([whole[a:b] for a, b in zip(at, at[1:], strict=False)])
                hashed = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(decode(tokenizer_path, x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(hashed), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", docs["text"].alias("__text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
