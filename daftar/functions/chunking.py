"""Splitters of texts into overlapping chunks. Fixed steps are expressions; splitters whose next start depends on the last end run as Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNKS = "array<struct<start:int,end:int,text:string>>"


def fixed_segments(c: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Segments of `size` characters, each beginning `overlap` before the last's end; none begins inside the last one's overlap only."""
    n = F.length(c)
    last = F.greatest(F.lit(0), n - overlap - 1)
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: c.substr(s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def segments(rows: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """key, chunk_index, content, tokens_count of every text."""
    from daftar.functions.text import token_count

    parts = rows.select(key, F.posexplode(fixed_segments(F.col(text), size, overlap)).alias("chunk_index", "content"))
    return parts.withColumn("tokens_count", token_count(F.col("content")))


def _backed_up(text: str, size: int, overlap: int, reach: int) -> list[dict]:
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = text.rfind(".", max(start + 1, end - reach), end)
            end = stop + 1 if stop > 0 else end
        out.append({"start": start, "end": end, "text": text[start:end]})
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def sentence_chunks(c: Column, size: int = 1000, overlap: int = 100, reach: int = 200) -> Column:
    """Chunks that end after a full stop where one stands among the last `reach` characters."""

    @F.pandas_udf(_CHUNKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _backed_up(t or "", size, overlap, reach))

    return split(c)


def _recursive(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Parts of at most `size` characters, cut at the coarsest separator that does; a separator stays with the part before it."""
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        if sep and sep in text:
            parts = [p + sep for p in text.split(sep)]
            parts[-1] = parts[-1][: -len(sep)]
            return [q for p in parts if p for q in _recursive(p, size, separators[k:] if len(p) < len(text) else separators[k + 1 :])]
    return [text[i : i + size] for i in range(0, len(text), size)]


def _merged(parts: list[str], size: int, overlap: int) -> list[dict]:
    out, held, at = [], [], 0
    length = 0
    for p in parts:
        if length + len(p) > size and held:
            out.append({"start": at, "end": at + length, "text": "".join(held)})
            while held and (length > overlap or length + len(p) > size):
                at, length = at + len(held[0]), length - len(held[0])
                held.pop(0)
        held.append(p)
        length += len(p)
    if held:
        out.append({"start": at, "end": at + length, "text": "".join(held)})
    return out


def recursive_chunks(c: Column, size: int = 400, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> Column:
    """Chunks up to `size`, cut at paragraphs, else lines, else words, else anywhere; whole parts are carried over as overlap."""

    @F.pandas_udf(_CHUNKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _merged(_recursive(t or "", size, separators), size, overlap))

    return split(c)


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to `size` characters and stripped; a chunk begins with the last parts of the one before, up to `overlap` characters of them, as far as they leave room for the next part."""
    out: list[str] = []
    first, total = 0, 0  # the open chunk is parts[first:i]
    for i, part in enumerate(parts):
        if total and total + len(part) > size:
            out.append("".join(parts[first:i]).strip())
            while total > overlap or total and total + len(part) > size:
                total -= len(parts[first])
                first += 1
        total += len(part)
    out.append("".join(parts[first:]).strip())
    return [x for x in out if x]


def _separated(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Cut at the first separator that the text holds, which stays at the beginning of the part behind it; parts of `size` or more are cut at the next separators."""
    at = next((i for i, sep in enumerate(separators) if sep in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    cuts = text.split(sep) if sep else list(text)
    parts = [p for i, x in enumerate(cuts) if (p := sep + x if i else x)]
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += _packed(short, size, overlap)
        short = []
        out += _separated(p, size, overlap, rest) if rest else [p]
    return out + _packed(short, size, overlap)


def separated_chunks(c: Column, size: int = 400, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Column:
    """Chunk texts up to `size` characters, cut at paragraphs, else lines, else words, else anywhere (by the empty separator, which comes last): separators stay before what follows them, chunks are stripped and never blank. None of a null text."""

    @F.arrow_udf(_BUDGETED)
    def split(texts: pa.Array) -> pa.Array:
        # Strings of few texts at once; what is done stands in Arrow's buffers.
        done = [pa.array([_separated(t, size, overlap, separators) if t else [] for t in texts.slice(i, ROWS).to_pylist()], pa.list_(pa.string())) for i in range(0, len(texts), ROWS)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return split(c)


#: Texts whose chunks are Python strings at once.
ROWS = 64
_BUDGETED = "array<string>"


def _budgeted(text: str, most: int, overlap: bool) -> list[str]:
    """Paragraphs packed up to `most` words, longer ones by sentence; with overlap a chunk begins with the last paragraph, or the last of several sentences, of the one before."""
    out: list[str] = []
    size = lambda x: len(x.split())

    def packed(parts: list[str], glue: str, least: int) -> None:
        held, count = [], 0
        for x in parts:
            n = size(x)
            if held and count + n > most:
                out.append(glue.join(held))
                held = held[-1:] if overlap and len(held) > least else []
                count = sum(map(size, held))
            held.append(x)
            count += n
        if held:
            out.append(glue.join(held))

    run: list[str] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if size(paragraph) <= most:
            run.append(paragraph)
            continue
        packed(run, "\n\n", 0)
        run = []
        packed([x for x in map(str.strip, re.split(r"[.!?؟]\s+", paragraph)) if x], " ", 1)
    packed(run, "\n\n", 0)
    return out


def budget_chunks(c: Column, most: int = 500, overlap: bool = True) -> Column:
    """Chunk texts of paragraphs up to `most` words; longer paragraphs by sentence."""

    @F.pandas_udf(_BUDGETED)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _budgeted(t or "", most, overlap))

    return split(c)


#: How articles and sections are named in chunks, Arabic and English.
ARTICLE_IN = {"ar": r"(?:المادة|الماده|مادة)\s*(?:رقم)?\s*(\d+|[٠-٩]+)", "en": r"(?i)(?:Article|Section|Clause)\s+(?:No\.?\s*)?(\d+)"}
SECTION_IN = {"ar": r"(?:الباب|الفصل|القسم)\s*(?:ال)?([\p{L}\p{N}_]+)", "en": r"(?i)(?:Chapter|Part|Section)\s+([\p{L}\p{N}_]+)"}


def chunk_metadata(content: Column, language: Column) -> Column:
    """article_number and section_title that a chunk names first, by its language; null without."""
    by = lambda held, group: F.nullif(F.when(language == "ar", F.regexp_extract(content, held["ar"], group)).otherwise(F.regexp_extract(content, held["en"], group)), F.lit(""))
    return F.struct(by(ARTICLE_IN, 1).alias("article_number"), by(SECTION_IN, 0).alias("section_title"))
