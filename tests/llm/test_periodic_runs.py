"""Periodic runs against a search of every lag word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from daftar.llm import periodic_runs, queries


def brute(w):
    """(start, length, smallest period) of all runs by start, then period."""
    runs = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                runs.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def planted(rng):
    n, letters = rng.choice([5, 12, 13, 30, 80, 200]), "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 20])]
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
            w[i] = w[i - p]
    return " ".join(w)


def texts():
    rng = random.Random(1)
    out = [planted(rng) for _ in range(1500)]
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    out += [" ".join(b), " ".join(b[:37] * 5), " ".join(b[:34] * 3 + b[:21] * 4)]
    return out + [None, "", " \n\t", "x", "Aa aA " * 6, " odd " * 14, "one two\n" * 6 + "three", *out[:3]]


def test_collapse_against_brute_force(spark):
    rows = [(i if i % 7 else None, t, i * 2, "keep") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, __f string").repartition(3)
    got = sorted((str(r.doc_id), r.text, r.n_words, r.n_runs, r.runs, r["__f"]) for r in periodic_runs.collapse(docs).collect())
    want = []
    for i, t, _, f in rows:
        w = (t or "").encode().split()
        runs = brute(w)
        want.append((str(i), brute_kept(w, runs).decode(), len(w), len(runs), [tuple(r) for r in runs], f))
    assert got == sorted(want)


@pytest.mark.parametrize("text,runs", [("a " * 300_000, 1), ("a " * 100_000 + "b " + "a " * 100_000, 2), ("a b " * 3000 + "b a " * 3000, 2999)])
def test_texts_of_one_word_or_two(text, runs):
    """Many places share every seed here; the seeds stay in proportion to the words."""
    from daftar.llm.words import spans, word_hashes

    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = spans(data, np.array([0, len(data)]))
    words = word_hashes(data, starts, ends)
    assert len(periodic_runs.seeds(words, first)[0]) < 20 * len(words)
    assert len(periodic_runs.stretches(words, first)[0]) == runs


def test_empty(spark):
    assert periodic_runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_run_detection"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        w = (d.text or "").encode().split()
        if len(w) > 3000:
            continue
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want = (d.doc_id, len(runs), s, length, q, None if q is None else 1000 * length // q, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(brute_kept(w, runs)))
        assert tuple(got[d.doc_id]) == want
        seen += bool(runs)
    assert seen > 3
