"""Suffix dedup against a table of all strings of 50 bytes."""

import hashlib
import random

import pytest

from daftar.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, kept int, rest int, `a.b` int"


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) of each row."""
    first, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - 49 if i is not None else 0):
            k = t[p : p + 50]
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - 49 if i is not None else 0):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([3, 40, 400]))]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, base = [prose(rng.randint(10, 40)) for _ in range(4)], prose(150)
    out = [(1, None), (2, ""), (None, base), (3, "é" * 300), (4, "é" * 90), (5, "a" * 3000), (6, "ab" * 400 + "xyz" * 300), (9, "ab" * 100 + "xyz" * 90), (7, base), (7, base), (7, prose(30) + base), (8, "x" * 49), (10, "x" * 49), (11, "x" * 50), (12, "x" * 50)]
    for i in range(150):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            t += rng.choice([prose(rng.randint(0, 60)), p, p[3 : rng.randint(40, 90)]])
        if rng.random() < 0.2:
            b = list(base)
            for _ in range(rng.randint(0, 4)):
                b[rng.randrange(len(b))] = "\t"
            t = "".join(b)
        out.append((rng.randint(0, 200), t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,step,size", [(1, 1 << 16, 4 << 20), (2, 128, 3000), (3, 64, 500)])
def test_remove_against_brute_force(spark, monkeypatch, seed, step, size):
    monkeypatch.setattr(suffix_dedup, "_STEP", step)
    monkeypatch.setattr(suffix_dedup, "_SLICE", size)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", n, n, n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(5)
    out = suffix_dedup.remove(docs)
    assert out.columns == ["doc_id", "spans", "rest", "a.b", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r.rest: r for r in out.collect()}
    assert len(got) == len(rows)
    for n, ((i, _), want) in enumerate(zip(rows, brute(rows), strict=True)):
        r = got[n]
        assert (r.doc_id, r.spans, r["a.b"]) == (i, "x", n)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, (i, n)


def test_deals_equal_strings_to_one_bucket_whatever_stands_beside():
    import numpy as np

    rng = random.Random(4)
    shared = bytes(rng.randrange(256) for _ in range(400))
    found = []
    for _ in range(2):
        beside = bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))
        text = beside + shared + bytes(rng.randrange(256) for _ in range(100))
        at, n, run = suffix_dedup.pieces(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert n.sum() == len(text) - 49 and n.max() < 40
        own = {a + j - len(beside): a + r - len(beside) for a, m, r in zip(at.tolist(), n.tolist(), run.tolist(), strict=True) for j in range(m)}
        found.append({s: r for s, r in own.items() if 0 <= s <= 350})
    assert found[0] == found[1] and len(found[0]) == 351


def test_empty(spark):
    assert suffix_dedup.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_suffix_array_dedup"](spark, sf).collect()}
    want = {d.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, brute([tuple(d) for d in docs]), strict=True)}
    assert got == want
