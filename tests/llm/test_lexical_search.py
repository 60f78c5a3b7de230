"""Ranked lexical search against scores of all documents, and the registered query against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from daftar.llm import lexical_search, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, rank int, score string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in tfs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(150)] + ["Straße", "ΣΑΣ", "x_y", "9"]
    prose = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, prose(rng.randint(0, 60))) for i in range(700)]
    docs += [(1000 + i, "the very same words W1 w2") for i in range(120)]  # ties
    docs += [(7, "another under a used id w3 w3"), (None, "w1 w2 w3 w4"), (2000, None), (2001, ""), (2002, "--- \x00"), (2003, prose(30_000)), docs[5], docs[5]]
    items = [(i, prose(rng.randint(1, 30))) for i in range(15)]
    items += [(20, None), (21, " ; "), (22, "nowhere"), (None, "w1"), (23, "w1 w1 W1"), (23, "very same"), (24, " ".join(vocabulary)), (25, "ΣΑΣ straße Straße")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("k,block,part", [(50, 1 << 20, 1 << 13), (3, 40, 64), (10**6, 200, 300)])
def test_search_against_all_scores(spark, monkeypatch, k, block, part):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "PART_DOCS", part)
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(frame, asked, k).collect())
    assert got == brute(docs, items, k)


def test_masks_are_left_out_once_the_rest_is_safe():
    """Of many groups of documents only those are scored whose bound reaches the best so far."""
    rng = np.random.default_rng(1)
    n, t = 4000, 40
    holds = rng.random((n, t)) < np.linspace(0.02, 0.6, t)
    doc, term = np.nonzero(holds)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * holds.sum(0) + 1))).astype(np.int64)
    part = lexical_search.Part(np.arange(n), np.full(n, 30, np.int32), holds.sum(1), term.astype(np.int32), np.ones(len(term), np.int32), weights, n, 30 * n)
    scored, exact = [], part.scores
    part.scores = lambda docs, terms: scored.append(len(docs)) or exact(docs, terms)
    best = lexical_search._Best(20)
    part.search(np.arange(t), best)
    every = exact(np.arange(n), np.arange(t))
    order = np.lexsort((np.arange(n), -every))[:20]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert sum(scored) < n / 10


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).count() == 0


def test_registered_query_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    name = "op12_ranked_lexical_search"
    got = queries.QUERIES[name](spark, sf)
    want = c.execute(queries.ORACLE_SQL[name])
    assert got.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
