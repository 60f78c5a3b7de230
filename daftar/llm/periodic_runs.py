"""Finds stretches of words that repeat with a period, and drops the repetitions (operator 11).

Seed-and-extend diagonals, all documents of a slice of text at once. A run of period q and LEAST words or more equals itself q words later over at
least max(LEAST - q, q) words: its guaranteed overlap. Lags are taken in octaves: 1 to 7 with seeds of 6 words, then 2**j to 2**(j + 1) - 1 with seeds of
2**j words, which every overlap of such a lag holds. Two places of one document with the same seed and a distance in the octave are a seed on the
diagonal of their lag. Seeds are taken in the order of their places; a table of the furthest word covered on each lag suppresses those that
lie in what an earlier one has covered, and the others are extended to both sides as far as the words q apart are equal.

Not all pairs of places are listed. A place whose seed also stands at most half the seed's length before it lies inside a periodic stretch; of
such places only the first, the head, is paired. That loses no run: if all seeds of a run's overlap are inside stretches of a smaller period, both
copies of the overlap lie in different maximal stretches of that period (in one, the whole run had it, by the theorem of Fine and Wilf); the
run begins where one of the two does, so one of the two first seeds is a head; and the first stretch reaches the second, as the overlap is as
long as the lag. So pairs inside one stretch but of neighbours, and of two stretches that don't touch, are left out. A place that isn't
inside a stretch has a few partners in an octave, and the heads' partners are bounded by the stretches' exponents, so the seeds of an octave
are in proportion to the words, also where one word fills the text. Places whose seed of one octave stands once in their document are out of
all later octaves, whose seeds begin with it.

A stretch found on several lags is one run, of the smallest.

Defined results: null and empty texts and texts of white space have no words and no runs; every row is judged by itself, whatever its id,
so ids may be null or repeated; further columns of any name are kept (n_words, n_runs and runs are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from daftar.llm.common import arrow_type, small_batches, text_slices
from daftar.llm.words import run_hashes, spans, word_hashes

#: A run has this many words at least, and twice its period.
LEAST = 12
#: Seed of the first octave, of lags below 8: the least overlap of a run of LEAST words, which one of period 6 has.
FIRST_SEED, FIRST_LAGS = 6, (1, 8)
_BLOCK = 32
RUNS = "array<struct<start:long,length:long,period:long>>"


def octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(words of a seed, least lag, first lag too many) for texts of up to `longest` words."""
    yield FIRST_SEED, *FIRST_LAGS
    lag = FIRST_LAGS[1]
    while 2 * lag <= longest:
        yield lag, lag, 2 * lag
        lag *= 2


def seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, words of the seed) of all seeds, places counted through all documents; first: index of each document's first word, and the end."""
    sizes = np.diff(first)
    at = np.flatnonzero(np.repeat(sizes >= LEAST, sizes)) if len(sizes) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    out = []
    for width, least, beyond in octaves(int(sizes.max(initial=0))):
        at = at[at + width <= end[at]]
        if not len(at):
            break
        key = run_hashes(words, at, width)
        order = np.argsort(key, kind="stable")  # and so by place, and by document
        at, key = at[order], key[order]
        same = (key[1:] == key[:-1]) & (doc[at[1:]] == doc[at[:-1]])
        again = np.r_[same, False] | np.r_[False, same]
        group = np.cumsum(np.r_[True, ~same])[again]
        head = ~np.r_[False, same & (at[1:] - at[:-1] <= width // 2)][again]
        at = at[again]
        chain = np.cumsum(head) - 1
        begun = np.flatnonzero(head)
        last = np.r_[begun[1:], len(at)][: len(begun)] - 1
        period = np.where(last > begun, at[np.minimum(begun + 1, len(at) - 1)] - at[begun], 0)  # of the stretch; 0: none
        stop = at[last] + width + period  # no word of the stretch stands here or later
        # One number orders by group and place, so that all partners in the octave are a range.
        spread = np.int64(len(words) + 2 * beyond + 1)
        place = group * spread + at
        for forward in (True, False):
            lo, hi = (place[begun] + least, place[begun] + beyond) if forward else (place[begun] - beyond + 1, place[begun] - least + 1)
            lo, hi = np.searchsorted(place, lo), np.searchsorted(place, hi)
            n = hi - lo
            mine = np.repeat(begun, n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            if not forward:  # heads have met each other already
                mine, other = other[~head[other]], mine[~head[other]]
            a, b = chain[mine], chain[other]
            apart = (period[a] > 0) & (period[b] > 0) & (at[begun[b]] >= stop[a])
            within = (a == b) & (other - mine > 1)
            left = ~apart & ~within
            mine, other = mine[left], other[left]
            out.append((at[mine], at[other] - at[mine], np.full(len(mine), width)))
        at = np.sort(at)
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


class _Steps:
    """Hashes of the runs of 32, 128, 512 and 2,048 words from every word on, made when a long extension asks for them."""

    SIZES = (2048, 512, 128, 32)

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.held = words, {}

    def __getitem__(self, size: int) -> np.ndarray:
        if size not in self.held:
            self.held[size] = run_hashes(self.words, np.arange(len(self.words) - size + 1), size)
        return self.held[size]


def _reach(steps: _Steps, at: np.ndarray, lag: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on, in direction `step`, equal those a lag later; room: at most as many."""
    out, words = np.zeros(len(at), np.int64), steps.words

    def block(left: np.ndarray) -> np.ndarray:
        n = np.minimum(room[left] - out[left], _BLOCK)
        ahead = np.arange(_BLOCK)
        inside = ahead < n[:, None]
        here = np.where(inside, at[left, None] + step * (out[left, None] + ahead), 0)
        equal = (words[here] == words[np.where(inside, here + lag[left, None], 0)]) & inside
        got = np.where(equal.all(1), _BLOCK, equal.argmin(1))
        out[left] += got
        return left[got == _BLOCK]

    far = block(np.arange(len(at)))
    for size in steps.SIZES if len(far) else ():
        left = far
        while len(left := left[room[left] - out[left] >= size]):
            here = at[left] + step * out[left] - (size - 1) * (step < 0)
            left = left[steps[size][here] == steps[size][here + lag[left]]]
            out[left] += size
    while len(far):
        far = block(far)
    return out


def stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs, by place and then period."""
    at, lag, width = seeds(words, first)
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, lag, doc))
    at, lag, width, doc = at[order], lag[order], width[order], doc[order]
    diagonal = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (lag[1:] != lag[:-1])]) - 1 if len(at) else at
    furthest = np.zeros(diagonal[-1] + 1 if len(at) else 0, np.int64)  # first word not covered yet, by diagonal
    found, left, steps = [], np.arange(len(at)), _Steps(words)
    while len(left):
        now = left[np.r_[True, diagonal[left[1:]] != diagonal[left[:-1]]]]  # the first seed of every diagonal that is not covered
        d = doc[now]
        back = _reach(steps, at[now] - 1, lag[now], at[now] - first[d], -1)
        ahead = _reach(steps, at[now] + width[now], lag[now], first[d + 1] - lag[now] - at[now] - width[now], 1)
        start, stop = at[now] - back, at[now] + width[now] + ahead
        furthest[diagonal[now]] = stop
        found.append((start, stop - start + lag[now], lag[now]))
        left = left[at[left] >= furthest[diagonal[left]]]
    if not found:
        return at, at, at
    start, length, lag = (np.concatenate([f[i] for f in found]) for i in range(3))
    long = length >= np.maximum(LEAST, 2 * lag)
    start, length, lag = start[long], length[long], lag[long]
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, lag = start[smallest], length[smallest], lag[smallest]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:-1] == 0


def collapse(docs: DataFrame) -> DataFrame:
    """docs (text, further columns) with text cut to the words that no run holds after its first period, joined by one space, and n_words, n_runs and runs: start (word, from 0), length and period of every run by start, then period."""
    docs = small_batches(docs).drop("n_words", "n_runs", "runs")
    names = docs.columns
    runs_type = T._parse_datatype_string(RUNS)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType()), T.StructField("runs", runs_type)])
    kinds = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                starts, ends, first = spans(data, offsets)
                whole = data.tobytes()
                start, length, period = stretches(word_hashes(data, starts, ends), first)
                keep = _kept(len(starts), start, length, period)
                edges = np.searchsorted(start, first)
                dropped = np.concatenate([[0], np.cumsum(~keep)])[first]
                texts = []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if dropped[i] == dropped[i + 1]:
                        texts.append(b" ".join(whole[offsets[i] : offsets[i + 1]].split()))
                    else:
                        k = np.flatnonzero(keep[a:b]) + a
                        texts.append(b" ".join(whole[x:y] for x, y in zip(starts[k].tolist(), ends[k].tolist(), strict=True)))
                begun = np.repeat(first[:-1], np.diff(edges))
                parts = [pa.array(x, pa.int64()) for x in (start - begun, length, period)]
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if name == "text" else rows.column(name) for name in names]
                columns += [pa.array(np.diff(first), pa.int64()), pa.array(np.diff(edges), pa.int64()), runs]
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.mapInArrow(run, schema)
