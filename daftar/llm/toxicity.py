"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained on labelled documents: one on all windows of WINDOW words of ordinary documents, one on windows of toxic
documents. Not every window of a toxic document is toxic text, so its windows are chosen by compression: in each of ROUNDS rounds a dictionary trained on
all folds but one measures the toxic documents of that fold, and the PER_TEXT windows of each document that it shortens most against ordinary text, cut to the PART words where it does so, train the next
round; no document judges itself. Windows of ordinary documents that the toxic dictionary shortens all the same train a further part of the ordinary one. Ordinary text is compressed with the ordinary dictionary; toxic text, which is ordinary
language too, with both.

A document is scored by windows of one word each. A word alone is too short for its compressed length to tell anything, so each is compressed inside a CARRIER, a text that both compressors hold and that costs the
same few bytes in each: what is left is how many bytes the word costs. A window's distance is the difference of the two lengths. A document's score is a logistic function of its largest distance, the mean
of its three largest, its shares of windows with a distance above 0 and above 1, the mean of all, and the logarithms of the numbers of its windows and of those with a distance above 1 and
above 2, calibrated on labelled documents kept apart from the
dictionaries that measure them there (a fold of toxic ones each time, a fifth of the ordinary ones), so that 0.5 is the calibrated threshold. Of the TRAININGS of the toxic dictionary, a task each, the one with the least loss there is kept.

The dictionaries and the calibration are fitted on a bounded sample of labelled documents: at most MOST_TOXIC toxic and MOST_ORDINARY ordinary ones, those whose
ids hash lowest, of at most MOST_BYTES bytes of text each kind; all windows of theirs count. Every document is scored over its whole text.

Defined results: null and empty texts get the score of a document without windows; a document with several labels counts as toxic if
any is; null ids and null labels are not learned from; without labels of both kinds, or with too little text to train a dictionary on, every score is the share of
toxic labels (0 where there are none); rows are kept one for one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.common import release, small_batches, text_slices

#: ORDINARY_BYTES and MORE_BYTES (for windows that the toxic dictionary shortens though they are ordinary) and the sizes in TRAININGS bound the dictionaries; both compressors have the same parameters.
WINDOW, LEVEL, ORDINARY_BYTES, MORE_BYTES, WINDOW_LOG = 8, 10, 96_000, 12_000, 17
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 2000, 4000, 32 << 20
ROUNDS, PER_TEXT, PART = 4, 3, 4
#: The toxic dictionary is trained once for each number of bytes in the second place, with segments of SEGMENT bytes by their runs of so many, and has so many bytes each time.
SEGMENT, TRAININGS = 16, ((1024, (8, 6)), (2048, (8, 6)), (2048, (8,)), (4096, (8, 6)))
_FOLD = 5


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def trained(samples: list[bytes], size: int, k: int = 0, d: int = 0) -> bytes:
    """What zstandard learns from samples; empty if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def compressor(content: bytes):
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=1 << WINDOW_LOG, window_log=WINDOW_LOG, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress


def nearest_part(window: bytes, plain, judge) -> bytes:
    """The run of PART words of a window that `judge` shortens most against `plain`."""
    words = window.split(b" ")
    runs = [b" ".join(words[i : i + PART]) for i in range(max(1, len(words) - PART + 1))]
    return max(runs, key=lambda r: len(plain(r)) - len(judge(r)))


def farthest(windows_: list[bytes], plain, judge) -> list[bytes]:
    """Of a document's windows the PER_TEXT that `judge` shortens most against `plain`, cut to their nearest parts."""
    far = sorted(((len(plain(w)) - len(judge(w)), -i) for i, w in enumerate(windows_)), reverse=True)[:PER_TEXT]
    return [nearest_part(windows_[-i], plain, judge) for distance, i in far if distance > 0]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], usual: bytes, size: int, runs: tuple[int, ...]) -> tuple[bytes, bytes, list[bytes]]:
    """(toxic, ordinary), from the windows of toxic and of ordinary documents, one list each, and what was trained on all of the latter; and for each fold of the toxic documents the toxic dictionary of the other folds."""

    def special(chosen: list[list[bytes]], left_out: int | None = None) -> bytes:
        samples = [w for i, c in enumerate(chosen) if i != left_out for w in c]
        return b"".join(trained(samples, size, SEGMENT, d) for d in runs)

    folds = [toxic[i::_FOLD] for i in range(_FOLD)]
    chosen = [[w for ws in fold for w in ws] for fold in folds]
    for r in range(ROUNDS + 1):
        if r == ROUNDS:  # what the toxic dictionary shortens in ordinary documents is ordinary: it joins the other's training
            plain, judge = compressor(usual), compressor(special(chosen) + usual)
            far = [max(ws, key=lambda w: len(plain(w)) - len(judge(w))) for ws in ordinary if ws]
            usual = trained([w for w in far if len(plain(w)) > len(judge(w))], MORE_BYTES, SEGMENT, 8) + usual
        plain, judges = compressor(usual), [compressor(special(chosen, i) + usual) for i in range(_FOLD)]
        chosen = [[w for ws in fold for w in farthest(ws, plain, judge)] for fold, judge in zip(folds, judges, strict=True)]
    return special(chosen), usual, [special(chosen, i) for i in range(_FOLD)]


#: Stands around each word that is measured; of characters that texts hardly have.
CARRIER = bytes(range(1, 9)) + bytes(range(14, 20)), bytes(range(20, 32))
FEATURES = 8
#: Words whose distance a scorer keeps, and how long they are at most.
_KEPT, _SHORT = 1 << 18, 64


class Scorer:
    """Scores texts by the two dictionaries and the calibrated weights."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        carrier = b"".join(CARRIER)
        self.of = [compressor(toxic + ordinary + carrier), compressor(ordinary + carrier)] if ordinary else None
        self.weights = np.array(weights)
        self.known: dict[bytes, int] = {}

    def distance(self, word: bytes) -> int:
        """How many bytes less a word costs in toxic text than in ordinary text."""
        toxic, ordinary = self.of
        window = b" ".join((CARRIER[0], word, CARRIER[1]))
        found = len(ordinary(window)) - len(toxic(window))
        if len(word) <= _SHORT:
            if len(self.known) >= _KEPT:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: bytes) -> list[float]:
        words = words_of(text) if self.of is not None else []
        if not words:
            return [0.0] * FEATURES
        held = list(map(self.known.get, words))
        if None in held:
            held = [self.distance(w) if h is None else h for w, h in zip(words, held, strict=True)]
        d = np.array(held)
        n, above = len(d), [int((d > k).sum()) for k in range(3)]
        best = np.sort(np.partition(d, n - 3)[n - 3 :] if n > 3 else d)
        return [float(best[-1]), float(best.mean()), 10 * above[0] / n, 10 * above[1] / n, 10 * float(d.mean()), math.log(n), math.log1p(above[1]), math.log1p(above[2])]

    def of_features(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.weights, -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.of_features(np.array([self.features(t) for t in texts]).reshape(-1, FEATURES))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; n: how many documents a row stands for."""
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], training: tuple[int, tuple[int, ...]]) -> tuple[float, bytes, bytes, list[float]]:
    """The loss on documents kept apart, both dictionaries and the weights. Without a dictionary: an endless loss."""
    learned = [t for i, t in enumerate(ordinary) if len(ordinary) < _FOLD or i % _FOLD]
    apart = [t for i, t in enumerate(ordinary) if len(ordinary) < _FOLD or not i % _FOLD]
    ordinary_windows = [windows(words_of(t)) for t in learned]
    usual = trained([w for ws in ordinary_windows for w in ws], ORDINARY_BYTES)
    if not usual or not toxic:
        return math.inf, b"", b"", [0.0] * (1 + FEATURES)
    found, usual, others = dictionaries([windows(words_of(t)) for t in toxic], ordinary_windows, usual, *training)
    none = [0.0] * (1 + FEATURES)
    s, judges = Scorer(found, usual, none), [Scorer(d, usual, none) for d in others]
    x = np.array([judges[i % _FOLD].features(t) for i, t in enumerate(toxic)] + [s.features(t) for t in apart])
    y = np.repeat([1.0, 0.0], [len(toxic), len(apart)])
    n = np.repeat([1.0, len(ordinary) / len(apart)], [len(toxic), len(apart)])
    s.weights = _logistic(x, y, n)
    p = np.clip(s.of_features(x), 1e-12, 1 - 1e-12)
    return -float(np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=n)), found, usual, s.weights.tolist()


@lru_cache(maxsize=4)
def _scorer(toxic: bytes, ordinary: bytes, weights: tuple[float, ...]) -> Scorer:
    return Scorer(toxic, ordinary, list(weights))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, list[float]]:
    """Both dictionaries and the weights, from the bounded sample of labelled documents that are not held out. Each of TRAININGS is one task; only ids and what was learned reach the driver."""
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    each = docs.select("doc_id", F.octet_length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    ids = each.join(labelled, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    chosen: list[tuple[int, int, int]] = []
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        held = 0
        for place, r in enumerate(ids.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(most).collect()):
            held += r["size"] or 0
            if held > MOST_BYTES:
                break
            chosen.append((r["doc_id"], toxic, place))
    n = sum(t for _, t, _ in chosen)
    share = n / len(chosen) if chosen else 0.0
    flat = b"", b"", [math.log((share + 1e-12) / (1 - share + 1e-12)), *[0.0] * FEATURES]
    if n in (0, len(chosen)):
        return flat
    bounded = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int, place int")  # at most MOST_TOXIC + MOST_ORDINARY rows
    texts = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))

    def train(table: pa.Table) -> pa.Table:
        number = table.column("training")[0].as_py()
        rows = sorted(zip(table.column("toxic").to_pylist(), table.column("place").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: r[:2])
        loss, toxic, ordinary, weights = fit(*([(t or "").encode() for kind, _, t in rows if kind == k] for k in (1, 0)), TRAININGS[number])
        del rows
        release()
        return pa.table({"training": pa.array([number], pa.int32()), "loss": pa.array([loss]), "toxic": pa.array([toxic], pa.binary()), "ordinary": pa.array([ordinary], pa.binary()), "weights": pa.array([weights], pa.list_(pa.float64()))})

    tried = texts.select("toxic", "place", "text", F.explode(F.sequence(F.lit(0), F.lit(len(TRAININGS) - 1))).alias("training"))
    tried = tried.repartition(4 * len(TRAININGS), "training").groupBy("training").applyInArrow(train, "training int, loss double, toxic binary, ordinary binary, weights array<double>")
    best = min(tried.collect(), key=lambda r: (r["loss"], r["training"]))
    return (bytes(best["toxic"]), bytes(best["ordinary"]), list(best["weights"])) if best["ordinary"] else flat


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with two more columns, score double and predicted int; docs has doc_id long and text; columns of these two names are replaced."""
    toxic, ordinary, weights = learn(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(toxic, ordinary, tuple(weights))
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                whole, at = data.tobytes(), offsets.tolist()
                score = s.scores([whole[a:b] for a, b in zip(at, at[1:], strict=False)])
                out = [rows.column(c) for c in names] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=[*names, "score", "predicted"])

    rest = small_batches(docs).drop("score", "predicted")
    names = rest.columns
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
