"""The pipeline's stages on the smallest tables."""

import random
import struct
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from daftar.llm import mixing, queries, toxicity


def test_stages(spark, sf):
    from daftar.llm.common import written

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "bpe"]
    docs = queries.table(spark, sf, "documents").withColumn("score", F.col("doc_id"))
    counts = [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        docs = written(stage(spark, docs, sf))
        counts.append(docs.count())
        assert docs.columns == list(p.COLUMNS) if i < 4 else "ids" in docs.columns
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0


def test_rows_of_one_id(spark, sf):
    """A near copy under an id doesn't take the id's other rows with it."""
    a, b = " ".join(f"a{i}" for i in range(70)), " ".join(f"b{i}" for i in range(65))
    rows = [(1, a), (5, a), (5, b), (5, a + " more"), (5, None), (6, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.one_of_each_group(spark, docs, sf)
    want = [(1, a), (5, b), (5, None), (None, a)]
    assert kept.columns == list(p.COLUMNS) and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())
    cut = p.without_repeated_passages(spark, docs, sf).where(F.col("doc_id") == 5).collect()
    assert sorted(r.text or "" for r in cut) == ["", "", b, "more"]


def fixture(spark):
    """Toxic words, copies and near copies, passages, rows of one id, repeated rows, nulls and empty texts, more than one source."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [prose(rng.randint(5, 130)) for _ in range(200)]
    for i in range(0, 200, 4):
        w = texts[i].split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(["zzrotten", "qqvermin", "xxfilth"]))
        texts[i] = " ".join(w)
    passage, base = prose(60), prose(150)
    texts += [f"{prose(20)} {passage} {prose(30)}" for _ in range(5)] + [f"{base} {prose(k)}" for k in range(6)] + [base, base]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(7, base, "en", "a", 9), (7, prose(60), "en", "a", 9), rows[9], rows[9], (9, texts[9], "xx", "a", 1), (300, None, "en", "a", 0), (301, "", None, "b", 0), (301, "  ", None, "b", 2), (None, passage, None, None, None), (302, passage, "en", "c", 1)]
    labels = [(i, int(i < 200 and i % 4 == 0)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int")


def brute_groups(rows):
    """One row of each component of rows by five-word sets at 0.8: least id, then any of least hash of text; linked rows only."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w and r[0] is not None else None)
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def brute_passages(rows):
    first = {}
    for r in rows:
        w = (r[1] or "").split()
        for p in range(len(w) - 49 if r[0] is not None else 0):
            k = tuple(w[p : p + 50])
            first[k] = min(r[0], first.get(k, r[0]))
    out = []
    for r in rows:
        w = (r[1] or "").split()
        gone = set()
        for p in range(len(w) - 49 if r[0] is not None else 0):
            if first[tuple(w[p : p + 50])] < r[0]:
                gone |= set(range(p, p + 50))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    return out


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage, on what its predecessor kept, row by row."""
    from tokenizers import Tokenizer

    from daftar.llm.common import written

    rows, docs, labels = fixture(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(p.STAGES)
    key = lambda rs: Counter(tuple(r) for r in rs)

    kept = written(stages["toxicity"](spark, docs, str(tmp_path)))
    special, usual, weights = toxicity.learn(docs, labels)
    scorer = toxicity.Scorer(special, usual, weights)
    want = [r for r in rows if scorer.scores([(r[1] or "").encode()])[0] < 0.5]
    assert key(kept.collect()) == key(want) and len(rows) - 60 < len(want) < len(rows) - 30

    found = written(stages["ngram_jaccard_join"](spark, kept, str(tmp_path)))
    sets, group = brute_groups(want)
    got = key(found.collect())
    assert got <= key(want)
    assert key(r for r in got.elements() if not (r[1] or "").split() or r[0] is None) == key(r for r, s in zip(want, sets, strict=True) if not s)
    for g in set(group):
        own = [want[i] for i in range(len(want)) if group[i] == g and sets[i]]
        stay = [r for r in got.elements() if r in own]
        assert not own or len(stay) == 1 and stay[0][0] == min(r[0] for r in own)
    want = [tuple(r) for r in found.collect()]

    cut = written(stages["substring_dedup"](spark, found, str(tmp_path)))
    want = brute_passages(want)
    assert key(cut.collect()) == key(want) and any(r[1] and len(r[1].split()) < 60 for r in want)

    some = written(stages["mixing"](spark, cut, str(tmp_path)))
    taken = Counter()
    for r in mixing.mix(cut).collect():
        assert r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    got = key(some.collect())
    assert set(got) <= set(key(want)) and all(n <= 2 * key(want)[r] for r, n in got.items())
    assert Counter({s: sum(n * len(r[1].split()) for r, n in got.items() if r[3] == s) for s in taken}) == taken
    sizes = Counter()
    for r in want:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = {r.source: r.target for r in mixing.mix(cut).collect()}
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6 and set(goal) == set(order)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 300 and goal[s] <= 2 * sizes[s] + 1e-9

    last = stages["bpe"](spark, some, str(tmp_path)).collect()
    t = Tokenizer.from_file(queries.BYTE_BPE)
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in last) == Counter((r[0], struct.pack(f"<{len(ids(r[1]))}I", *ids(r[1])), len(ids(r[1])), r[1] or "") for r in got.elements())


def test_rows_of_one_id_and_repeated_rows(spark, sf):
    """An unrelated text under the id of a copy stays; of equal rows one stays."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, "c d e f g h"), (3, "c d e f g h"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in p.one_of_each_group(spark, docs, sf).collect()) == [(1, a), (2, b), (3, "c d e f g h"), (4, ""), (4, "")]


def test_empty_documents(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
