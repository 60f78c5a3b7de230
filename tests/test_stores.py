"""Hash trees, trigram search, ranked and keyed tables, bitmaps of users and locks, with their special cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.operators import hash_tree, locks, trigram, user_bitmaps
from daftar.operators.catalog import contains_any
from daftar.operators.pages import RankedTable
from daftar.sources.store import KeyedStore
from daftar.streaming import activity


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def counters(a, b):
    return {"n_a": len(a), "n_b": len(b), "n_both": len(a & b), "n_a_only": len(a - b), "n_b_only": len(b - a)}


def test_reconciliation_by_tree(spark):
    rng = random.Random(1)
    for n, drop, add in ((2000, 3, 2), (300, 0, 0), (0, 0, 5), (50, 50, 0)):
        a = {rng.randrange(10**9) for _ in range(n)} | ({None} if n == 2000 else set())
        b = (a - set(rng.sample(sorted(x for x in a if x is not None), drop))) | {-rng.randrange(10**9) - 1 for _ in range(add)}
        repeated = [(x,) for x in a] * 2
        x, y = spark.createDataFrame(repeated, "k long"), spark.createDataFrame([(x,) for x in b], "k long")
        assert hash_tree.reconciliation(x, y, "k").first().asDict() == counters(a, b)
        want = {(k, "a") for k in a - b} | {(k, "b") for k in b - a}
        assert {tuple(r) for r in hash_tree.differences(x, y, "k").collect()} == want


def test_equal_tables_move_no_key(spark, tmp_path):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    trees = tuple(hash_tree.tree(rows, "k", unique=True) for _ in range(2))
    assert trees[0].where("level = 0").count() == 1 and trees[0].where("level = 4").agg(F.sum("n")).first()[0] == 5000
    out = hash_tree.reconciliation(rows, rows, "k", unique=True, trees=trees)
    assert out.first().asDict() == {"n_a": 5000, "n_b": 5000, "n_both": 5000, "n_a_only": 0, "n_b_only": 0}
    assert "Range" not in plan(out)  # the keys' table isn't read again
    changed = rows.where("k <> 77").unionByName(spark.createDataFrame([(-1,)], "k long"))
    leaves = hash_tree.unequal_leaves(trees[0], hash_tree.tree(changed, "k", unique=True))
    assert len(leaves) == 2


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(3)
    parts = ["Nation", "ration", "a_b", "100%", "é", "ÉCOLE", "xy", " ", "\n", "İz", "سلام", "aaa"]
    rows = [(i - 40, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))), rng.choice([None, "", "station", "x"])) for i in range(400)]
    rows += [(None, "nation", "x"), (70_000, "a nation far away", None), (5, "a second row: aaaa", "x"), (9, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    trigram.write_index(df, "id", ["text", "source"], path, 16)
    return df, path


@pytest.mark.parametrize("term", ["ation", "NATION", "a_b", "a__nat", "ion%rat", "école", "aaa", "aaaa", "xy", "", "سلا", "nowhere", "100\\%", "%", "xyé"])
def test_trigram_search_equals_scan(spark, texts, term):
    df, path = texts
    got = sorted(map(str, trigram.search(df, "id", ["text", "source"], term, path, 16).collect()))
    assert got == sorted(map(str, df.where(contains_any(["text", "source"], term)).collect()))


def test_trigram_search_reads_the_parts_of_its_term(spark, texts):
    _, path = texts
    every = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    grams = trigram.needed(spark, "%Nat_ion")
    assert grams == ["ion", "nat"]
    read = trigram.postings(spark, path, grams, 16)
    assert "PartitionFilters: [" in plan(read) and "PartitionFilters: []" not in plan(read)
    assert read.select(F.input_file_name()).distinct().count() <= 2 < every


def test_lists_of_trigrams_are_bounded():
    """A task lists its rows by trigram as they come, in slices: whatever the number of rows, it holds few."""
    import itertools

    import pyarrow as pa

    taken, rng = [], random.Random(4)
    texts_ = ["old red widget", "", None, "ab", "a😀b😀c", "aaaa" * 90_000, *("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(3000))]

    def batches():
        for i in itertools.count():  # never ends
            taken.append(i)
            n = len(texts_)
            yield pa.RecordBatch.from_arrays([pa.array([i % 3] * n), pa.array(range(n)), pa.array(texts_), pa.array(["xyz", None] * (n // 2))], names=["block", "place", "text0", "text1"])

    found = {}
    for r in next(trigram._partial_postings(batches())).to_pylist():
        places = [int.from_bytes(r["places"][j : j + 2], "little") for j in range(0, len(r["places"]), 2)]
        found[r["trigram"], r["block"]] = set(places)
    assert len(taken) < 30
    want = {}
    for i, t in enumerate(texts_):
        for x in (t or "", "" if i % 2 else "xyz"):
            for j in range(len(x) - 2):
                want.setdefault(x[j : j + 3], set()).add(i)
    assert {g: p for (g, b), p in found.items() if b == 0} == want


def test_ranked_pages(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i, rng.choice([None, "x"])) for i in range(1003)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(3)
    ranked = RankedTable(spark, str(tmp_path / "r"), [F.desc("a"), "b"]).create(df, 16)
    again = RankedTable(spark, str(tmp_path / "r"), [F.desc("a"), "b"])
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert again.total() == 1003 and again.pages(20) == 51
    for number, size in ((1, 20), (2, 20), (51, 20), (52, 20), (3, 300), (1, 5000), (7, 1)):
        assert [tuple(r) for r in ranked.page(number, size).collect()] == want[(number - 1) * size : number * size], number
    last = again.page(51, 20)
    assert last.select(F.input_file_name()).distinct().count() == 1 and "PartitionFilters: [" in plan(last)
    with pytest.raises(ValueError):
        ranked.page(0, 20)
    empty = RankedTable(spark, str(tmp_path / "e"), ["a"]).create(df.where("false"), 4)
    assert empty.total() == 0 and empty.page(1, 20).count() == 0


def files(path):
    return {str(p) for p in path.rglob("part-*")}


def test_keyed_store(spark, tmp_path):
    schema = "k long, part string, v string, m map<string,int>"
    rows = [(i, "a", f"v{i}", {"x": i}) for i in range(200)] + [(None, "a", "none", None)]
    path = tmp_path / "s"
    store = KeyedStore(spark, str(path), ["k", "part"], 32).create(spark.createDataFrame(rows, schema))
    before = files(path)
    new = [(5, "a", "old", {"x": 1}, 1), (5, "a", "new", {"x": 2}, 2), (5, "a", "older", None, 0), (900, "b", "added", None, 1), (None, "a", "changed", None, 1)]
    touched = store.upsert(spark.createDataFrame(new, schema + ", at int"), F.col("at"))
    want = {(r[0], r[1]): r[2:] for r in rows} | {(5, "a"): ("new", {"x": 2}), (900, "b"): ("added", None), (None, "a"): ("changed", None)}
    held = lambda: {(r.k, r.part): (r.v, r.m) for r in store.rows().collect()}
    assert held() == want and store.count() == 202
    after = files(path)
    assert len(touched) <= 3 and len(before - after) <= 3 and len(before & after) >= len(before) - 3  # all else keeps its files
    assert [tuple(r) for r in store.get((5, "a"), (6, "b")).collect()] == [(5, "a", "new", {"x": 2})]
    assert store.get((5, "a")).select(F.input_file_name()).distinct().count() == 1
    assert store.peek(3).count() == 3
    store.patch(spark.createDataFrame([(7, "a", None, {"y": 1}, 1), (7, "a", "patched", None, 2), (12345, "a", "nowhere", None, 1)], schema + ", at int"), F.col("at"))
    want[7, "a"] = ("patched", {"x": 7})
    assert held() == want
    one = [r for r in want if r[0] is not None and r[0] < 100]
    store.delete(spark.createDataFrame(one + [(777, "z")], "k long, part string"))
    assert held() == {k: v for k, v in want.items() if k not in one}
    store.delete(spark.createDataFrame(list(want), "k long, part string"))
    assert not files(path) or store.count() == 0


def test_user_bitmaps(spark):
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=rng.randrange(86400 * 2)), rng.choice([None, *range(1, 40), 33000, 70001])) for _ in range(3000)] + [(None, 3)]
    slices = user_bitmaps.slices(spark.createDataFrame(rows, "ts timestamp_ntz, user_id long"))
    for a, b in ((0, 48), (3, 4), (5, 5), (100, 200)):
        start, end = t0 + timedelta(hours=a), t0 + timedelta(hours=b)
        want = len({u for t, u in rows if t and u is not None and start <= t < end})
        assert user_bitmaps.distinct_users(slices.unionByName(slices), start, end).first().n_users == want  # rows that come twice count once
    with pytest.raises(ValueError):
        user_bitmaps.slices(slices, minutes=25)


def brute_locks(ts, failed, most, lock, forget):
    failures, last, until, out = 0, 0, 0, []
    for t, bad in zip(ts, failed, strict=True):
        if until and t < until:
            continue
        if not bad:
            failures = 0
            continue
        failures = 1 if failures and t - last >= forget else failures + 1
        last = t
        if failures >= most:
            out.append(t)
            until, failures = t + lock, 0
    return out


def test_locks_step_by_step():
    rng = random.Random(1)
    for _ in range(3000):
        n, p = rng.randint(0, 40), rng.choice([0.5, 0.8, 0.95])
        ts = np.cumsum([rng.choice([0, 1, 1, 2, 5, 30]) for _ in range(n)]).astype(np.int64) + 1
        failed = np.array([rng.random() < p for _ in range(n)], bool)
        most, lock, forget = rng.choice([1, 2, 3, 5]), rng.choice([1, 3, 10]), rng.choice([4, 20, 1000])
        got, state, i = [], locks.State(), 0
        while i < n:  # in batches of any size
            j = i + rng.choice([1, 2, 5, 100])
            more, state = locks.locks(ts[i:j], failed[i:j], state, most, lock, forget)
            got, i = got + more, j
        assert got == brute_locks(ts.tolist(), failed.tolist(), most, lock, forget)


def attempts(seed, users=12, n=900):
    rng, t, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(minutes=rng.choice([0, 1, 2, 10, 60]))
        rows.append((i, t, rng.choice([*range(users)]), "error" if rng.random() < 0.85 else "view"))
    return rows


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def test_locked_users(spark):
    rows = attempts(2) + [(-1, datetime(2024, 1, 1), None, "error"), (-2, None, 3, "error")]
    got = sorted(tuple(r) for r in locks.locked(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("event_type") == "error").collect())
    want = []
    for u in range(12):
        own = sorted((t, i, k) for i, t, x, k in rows if x == u and t)
        us = [round((t - datetime(1970, 1, 1)).total_seconds() * 1e6) for t, _, _ in own]
        want += [(u, datetime(1970, 1, 1) + timedelta(microseconds=b), datetime(1970, 1, 1) + timedelta(microseconds=b, minutes=30)) for b in brute_locks(us, [k == "error" for *_, k in own], 5, 30 * locks.MINUTE, locks.FORGET)]
    assert got == sorted(want) and len(got) > 20


def test_stream_of_locks_equals_batch(spark, tmp_path):
    rows = attempts(4)
    rows += [(10_000 + i, datetime(2025, 1, 1) + timedelta(days=i), 99, "view") for i in range(3)]  # so that the watermark passes all timers
    for i in range(0, len(rows), 150):
        spark.createDataFrame(rows[i : i + 150], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:05d}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = activity.events(spark, str(tmp_path / "in/*"), SCHEMA, 1)
        q = activity.locked(stream).writeStream.format("memory").queryName("locked_stream").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset(provider)
    got = sorted((r.user_id, r.locked_at, r.locked_until) for r in spark.table("locked_stream").collect())
    batch = locks.locked(spark.createDataFrame(rows, SCHEMA), F.col("event_type") == "error")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 20
    assert left == 0  # no state of idle users
