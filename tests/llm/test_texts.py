"""Text operators against brute force, on fixtures with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daftar.llm import bpe, jaccard_join, mixing, queries, substring_dedup, toxicity, wavelet
from daftar.llm.components import components
from daftar.llm.words import run_hashes, spans, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, places binary"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(300).split()
    texts = [None, "", "   ", "one", "one two three", "it's <|endoftext|>  We're", "x" * 20000, "\u00a0odd\u3000space \u2003 here\x1cand\x85", "Ünïcode straße ΣΑΣ 12,5%\n\n\ttab", prose(6000)]
    texts += [prose(120) + " " + passage + "\n" + prose(rng.randint(1, 80)) for _ in range(12)] + [passage] * 3
    for _ in range(60):  # near copies
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [prose(rng.randint(1, 200)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or ""), 0.5, 1, None) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "a", 0, 0.5, 1, None), (4, "another text under an id that is used", "en", "b", 0, 0.5, 1, None), (None, " ".join(base), "en", "c", 0, 0.5, 1, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/fixture-docs"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def brute_sets(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, rows, width, percent):
    sets = [(r[0], brute_sets(r[1], width)) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    want = sorted((str(a), len(x), str(None if a is None else least[find(i)])) for i, (a, x) in enumerate(sets))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(docs, width, percent).collect())
    assert got == want


@pytest.mark.parametrize("block", [20, 1024])
def test_jaccard_join_lists_of_many_strangers(spark, monkeypatch, block):
    """Long lists whose sets are similar to some and not to others, so that the second round decides, in many blocks and in one."""
    monkeypatch.setattr(jaccard_join, "_BLOCK", block)
    rng = random.Random(5)
    core = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(sorted(set(core + own)))))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()}
    sets = {i: brute_sets(t, 1) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def brute_removed(rows):
    first = {}
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in split:
        for p in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[p : p + 50])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, rows):
    got = substring_dedup.remove(docs.select("doc_id", "text"), digest=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
    whole = substring_dedup.remove(docs)
    assert set(whole.columns) == {*docs.columns, "n_words", "n_removed"}
    texts = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in whole.collect())
    assert texts == brute_removed(rows)


def test_substring_dedup_rows_of_one_id(spark):
    """A copy under an id doesn't take the id's other rows with it, whatever order and partition they come in."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = prose(70), prose(65), prose(90)
    rows = [(1, a), (5, a), (5, b), (5, "  " + a), (5, None), (5, a[:20]), (5, c + " " + a), (6, b), (6, c), (7, prose(60)), (None, b)]
    for parts in (1, 4):
        got = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), digest=True).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
    assert ("5", 65, 0, hashlib.sha256(b.encode()).hexdigest()) in brute_removed(rows)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def hashed(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, first = spans(data, offsets)
    return word_hashes(data, starts, ends), first


def test_hashes_of_runs():
    words, first = hashed([b"a b c a b", b"", b" c a b "])
    assert first.tolist() == [0, 5, 5, 8]
    two, three = run_hashes(words, np.array([0, 3, 6]), 2), run_hashes(words, np.array([2, 5]), 3)
    assert len(set(two.tolist())) == len(set(three.tolist())) == 1 and two[0] != three[0]
    assert len(set(run_hashes(words, np.arange(7), 2).tolist())) == len({"a b", "b c", "c a"}) + len({"b c over the border"}) - 1 and len(run_hashes(words, np.zeros(0, int), 9)) == 0


def test_hashes_have_no_structured_collisions():
    """Thue-Morse words, runs and their complements collide under any polynomial modulo a power of two."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 32, 33, 1024, 4096):
        assert len(set(hashed([morse[:n].encode(), other[:n].encode()])[0].tolist())) == 2
        words, first = hashed([" ".join(morse[:n]).encode(), " ".join(other[:n]).encode()])
        assert len(set(run_hashes(words, first[:-1], n).tolist())) == 2
    rng = random.Random(2)
    some = [bytes(rng.choices(b"abc", k=rng.randint(1, 70))) for _ in range(20000)]
    words = hashed([b" ".join(some)])[0]
    assert len(set(zip(some, words.tolist(), strict=True))) == len(set(some)) == len(set(words.tolist()))


def test_bpe(docs, rows):
    t = Tokenizer.from_file(queries.BYTE_BPE)
    want = sorted((str(r[0]), np.array(t.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes(), r[1] or "") for r in rows)
    got = bpe.encode_documents(docs, queries.BYTE_BPE).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_bpe_chunk_borders():
    """Every way of cutting gives the library's ids."""
    t = Tokenizer.from_file(queries.BYTE_BPE)
    text = "It's  a\n\n test,we'll see <|endoftext|> of 12 cuts.   End  " * 30
    e = bpe.ChunkEncoder(queries.BYTE_BPE)
    want = bpe.pack(t.encode(text, add_special_tokens=False).ids)
    for bits in (2, 4, 6):
        cut = bpe.cut_points
        try:
            bpe.cut_points = lambda data, b=bits, f=cut: f(data, b)
            assert e.encode([text.encode()] * 2) == [want] * 2
        finally:
            bpe.cut_points = cut


def test_bpe_memories(monkeypatch):
    """Small memories that are emptied all the time change nothing; shared chunks are found."""
    t = Tokenizer.from_file(queries.BYTE_BPE)
    rng = random.Random(9)
    shared = " ".join(f"shared{rng.randrange(10**6)}" for _ in range(2000))
    texts = [f"{rng.random()} {shared} {rng.random()}\n" for _ in range(6)] + ["", " ", "a", "\n\n a  b "]
    want = [bpe.pack(t.encode(x, add_special_tokens=False).ids) for x in texts]
    e = bpe.ChunkEncoder(queries.BYTE_BPE)
    assert [x for t in texts for x in e.encode([t.encode()])] == want and e.found > 2 * e.missed
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(bpe, "_MAX_PIECES", 10)
    e = bpe.ChunkEncoder(queries.BYTE_BPE)
    assert [x for t in texts for x in e.encode([t.encode()])] == want and e.size <= 5000


def test_bpe_joins_are_repaired():
    """A join whose neighbours' ids don't come out reaches further, and at last over the whole text."""
    text = "one two three four five six seven eight nine ten " * 200
    e = bpe.ChunkEncoder(queries.BYTE_BPE)
    want = e.whole(text)
    assert e.encode([text.encode()]) == [want] and e.repaired == 0
    for chunk in e.chunks.values():
        if chunk:
            chunk.first[0] = (chunk.first[0][0], b"none")
    assert e.encode([text.encode()]) == [want] and e.repaired > 0


def test_wavelet_files(spark, docs, rows):
    t = Tokenizer.from_file(queries.WORD_BPE)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for r in ordered:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((str(r[0]), at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    shards = wavelet.write_shards(docs, queries.WORD_BPE, shard_tokens=5000)
    assert shards.count() > 3
    got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(shards).collect()]
    assert sorted(got) == sorted(want)
    assert wavelet.read_documents(wavelet.write_shards(docs.limit(0), queries.WORD_BPE)).count() == 0


@pytest.mark.parametrize("n", [1, 5000, wavelet.BLOCK_BITS, 3 * wavelet.BLOCK_BITS + 5])
def test_wavelet_access(n):
    tokens = np.random.default_rng(1).integers(0, 300, n).astype(np.uint16)
    blob = wavelet.build(tokens, np.array([0, min(10, n), n]))
    w = wavelet.Wavelet(blob)
    assert w.starts().tolist() == [0, min(10, n), n] and (w.tokens() == tokens).all()
    for i in {0, min(511, n - 1), n // 2, n - 1}:
        assert w[i] == tokens[i]
    for token in (0, 7, 299, 301):
        assert w.count(token, 0, n) == int((tokens == token).sum()) and w.count(token, n // 3, n // 2) == int((tokens[n // 3 : n // 2] == token).sum())
        assert w.places(token, 0, min(n, 600)) == np.flatnonzero(tokens[:600] == token).tolist()
        assert w.places(token, max(0, n - 300)) == [i for i in range(max(0, n - 300), n) if tokens[i] == token]


def test_wavelet_opens_few_blocks():
    """One access opens one block a plane, a count two, a place one more, of the 160 here."""
    tokens = np.random.default_rng(1).integers(0, 2**16, 10 * wavelet.BLOCK_BITS).astype(np.uint16)
    blob = wavelet.build(tokens, np.array([0, len(tokens)]))
    w = wavelet.Wavelet(blob)
    assert w[123456] == tokens[123456] and w.opened == 16
    w = wavelet.Wavelet(blob)
    token = int(tokens[200000])
    assert w.count(token) == int((tokens == token).sum()) and w.opened <= 32
    w = wavelet.Wavelet(blob)
    assert w.places(token, 199990, 200010) == [i for i in range(199990, 200010) if tokens[i] == token] and w.opened <= 48


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {n: sum(size(r[1]) for r in rows if r[3] == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, left = {}, set(names)
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[n] for n in names if n not in left)
        target = {n: rest * weight[n] / sum(weight[m] for m in left) if n in left else 2.0 * total[n] for n in names}
        over = {n for n in left if target[n] > 2 * total[n]}
        if not over:
            break
        left -= over
    for n in names:
        own = [r for r in got if r.source == n]
        assert sum(r.size for r in own) == total[n] == own[0].source_size
        assert abs(own[0].target - target[n]) < 1e-6
        assert abs(sum(r.taken for r in own) - target[n]) <= 2 * max(r.size for r in own) + 1
    assert all(r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.h, r.taken) for r in got) == sorted((str(r.doc_id), r.h, r.taken) for r in again)
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_rows_that_differ_elsewhere(spark):
    """Rows that agree in id, source and text and differ in another column, and rows that agree in all, are each taken for themselves."""
    text = "a b c d e"
    rows = [(1, text, "en", "s", 1), (1, text, "de", "s", 1), (1, text, None, "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 0), (None, "x y", None, "s", 3), (None, "x y", "s", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs, budget=2.0).collect())
    assert got == Counter({r: 2 * n for r, n in Counter(rows).items() if r[1]})
    some = mixing.mix(docs).collect()
    assert sum(r.taken for r in some) == sum(n * len(r[1].split()) for r, n in Counter(tuple(r) for r in mixing.mixed_documents(docs).collect()).items())


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)] + [(None, True), (5, None)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    out = toxicity.classify(docs, labels)
    assert set(out.columns) == {*docs.columns, "predicted"} and out.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    assert {r.score < 0.5 for r in toxicity.score(docs, labels.limit(0)).collect()} == {True}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_accuracy(spark, sf_large):
    """Held-out accuracy of the registered query on the given tables, which no label was learned from."""
    labels = spark.read.parquet(f"{sf_large}/labels.parquet")
    scored = queries.QUERIES["op10_toxicity"](spark, sf_large).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    toxic, other = ([r for r in scored if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.95
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.94
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.65
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in other)
    assert above / (len(toxic) * len(other)) >= 0.9  # area under the curve


def toxic_corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(900)]
    out = []
    for i in range(400):
        w = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zzrotten", "qqvermin", "xxfilth"]))
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_by_brute_force(spark):
    """Scores recomputed text by text from both dictionaries, which are zstandard's own and trained on their own texts."""
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "zzrotten qqvermin")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    special, usual, weights = toxicity.learn(docs, labels)
    assert all(w in special for w in (b"zzrotten", b"qqvermin", b"xxfilth")) and not any(w in usual for w in (b"zzrotten", b"qqvermin", b"xxfilth"))

    def length(content, window):
        params = zstandard.ZstdCompressionParameters.from_level(10, source_size=128, dict_size=1 << 17, window_log=17, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for i, text in [r[:2] for r in rows[:40]] + [(900, None)]:
        w = (text or "").encode().lower().split()
        ends = bytes([*range(1, 9), *range(14, 20)]), bytes(range(20, 32))  # what each word stands between, and both dictionaries hold
        d = [length(usual + b"".join(ends), x) - length(special + usual + b"".join(ends), x) for x in (b" ".join((ends[0], y, ends[1])) for y in w)]
        far, over = sorted(d)[-3:], [sum(y > k for y in d) for k in range(3)]
        x = [1.0, far[-1], sum(far) / len(far), 10 * over[0] / len(d), 10 * over[1] / len(d), 10 * sum(d) / len(d), math.log(len(d)), math.log1p(over[1]), math.log1p(over[2])] if d else [1.0] + [0] * 8
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True))))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[r[0]].predicted, r[2]) for r in rows if got[r[0]].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = toxic_corpus()
    seen = []
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for most in (20_000, 1 << 25):
        monkeypatch.setattr(toxicity, "MOST_BYTES", most)
        monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, training: (0.0, pickle.dumps((toxic, ordinary)), b"x", [0.0] * 9))
        seen.append(pickle.loads(toxicity.learn(docs, labels)[0]))
    assert all(10_000 < sum(map(len, ts)) <= 20_000 for ts in seen[0])
    learned = {r[1].encode() for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert set(seen[1][0]) | set(seen[1][1]) == learned


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert jaccard_join.join(none, 4, 85).count() == 0
    assert substring_dedup.remove(none).count() == 0
    assert bpe.encode_documents(none, queries.BYTE_BPE).count() == 0


NAMED = "doc_id long, _key string, text string, source string, _row int, _copies int, _copy int, __f string, __places int"


def test_columns_with_the_operators_own_names(spark):
    """Further columns keep their names and values, also where an operator has columns of these names."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"keep{i}", f"{passage} own{i}", "a" if i % 2 else "b", i, i + 1, i + 2, f"f{i}", i + 3) for i in range(6)]
    docs = spark.createDataFrame(rows, NAMED)
    cut = substring_dedup.remove(docs)
    assert cut.columns == [*docs.columns, "n_words", "n_removed"]
    for r in cut.collect():
        own = rows[r.doc_id]
        assert tuple(r)[:2] + tuple(r)[3:9] == own[:2] + own[3:] and r.n_removed == (60 if r.doc_id else 0) and r.text == (own[2] if not r.doc_id else f"own{r.doc_id}")
    taken = mixing.mix(docs.select("doc_id", "text", "source"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    assert mixed.count() >= 0.8 * taken.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("name,operator,parts", [
    ("op3_ngram_jaccard_join", lambda d: jaccard_join.join(d, 4, 85), ("doc_id", "n_shingles", "component_id")),
    ("op6_substring_dedup", lambda d: substring_dedup.remove(d.select("doc_id", "text"), digest=True), ("doc_id", "n_words", "n_removed", "kept_sha256")),
    ("op8_mixing_sources", lambda d: mixing.mix(d), ("doc_id", "size", "source_size", "target", "taken")),
])
def test_registered_queries_have_the_stated_parameters(spark, sf, name, operator, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, want = queries.QUERIES[name](spark, sf), operator(docs)
    key = lambda df: sorted(str(tuple(r[c] for c in parts)) for r in df.collect())
    assert key(got) == key(want)


def test_registered_bpe_and_binary_output(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    byte, word = (Tokenizer.from_file(p) for p in (queries.BYTE_BPE, queries.WORD_BPE))
    got = {r.doc_id: r for r in queries.QUERIES["op5_bpe_encoding_and_decoding"](spark, sf).collect()}
    for d in docs:
        ids = byte.encode(d.text or "", add_special_tokens=False).ids
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), *want)
    read, start = {r.doc_id: r for r in queries.QUERIES["op7_token_id_binary_output"](spark, sf).collect()}, 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = [*word.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (read[d.doc_id].start, read[d.doc_id].n_tokens, read[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
