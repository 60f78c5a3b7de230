"""Items of JSON files by byte ranges against json.loads of the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from daftar.sources import json_items as J


@pytest.fixture
def ranges(spark):
    """Lets files be read in ranges of the given size."""

    def small(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield small
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ":", ",", " ", "a", "é", "\n", "م"]) for _ in range(rng.randint(0, 12)))
    if kind < 5:
        return rng.choice([None, True, 12, -1.5])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["articles", "x}", "item", 'q"', "text", "law_sources"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def items(root, path):
    """Objects at a path, as an incremental reader gives them."""
    at = [root]
    for key in path.split("."):
        at = [y for x in at for y in (x if key == "item" and isinstance(x, list) else [x[key]] if key != "item" and isinstance(x, dict) and key in x else [])]
    return [x for x in at if isinstance(x, dict)]


def law(rng, n):
    return {"name": value(rng), "law_sources": {"other": [value(rng) for _ in range(5)], "articles": [{"article": str(i), **({"v": value(rng)} if rng.random() < 0.8 else {})} for i in range(n)], "tail": value(rng)}, "end": value(rng)}


@pytest.mark.parametrize("size", [20, 97, 1000, 1 << 20])
@pytest.mark.parametrize("path", ["law_sources.articles.item", "item", "item.articles.item"])
def test_items_of_ranges(spark, tmp_path, ranges, path, size):
    rng, want = random.Random(size), {}
    for f in range(4):
        root = law(rng, 40) if path.startswith("law") else [law(rng, 3)["law_sources"] if rng.random() < 0.7 else value(rng) for _ in range(15)]
        text = json.dumps(root, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        (tmp_path / f"{f}.json").write_text(text, encoding="utf-8-sig" if f == 3 else "utf-8")
        want[f"{f}.json"] = items(root, path)
    ranges(size)
    got = {}
    for r in J.json_items(spark, str(tmp_path), path).orderBy("path", "start", "number").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(json.loads(r.item))
    assert got == {k: v for k, v in want.items() if v}


def test_files_that_end_early_or_late(spark, tmp_path, ranges):
    whole = json.dumps([{"a": "x}" * 30, "n": i} for i in range(20)])
    for size in (25, 1 << 20):
        ranges(size)
        for cut in (len(whole) - 1, len(whole) - 2, len(whole) - 20, 300):
            folder = tmp_path / f"{size}-{cut}"
            folder.mkdir()
            (folder / "f.json").write_text(whole[:cut])
            n = sum(1 for i in range(20) if whole.index(f'"n": {i}}}') + len(f'"n": {i}}}') <= cut)
            assert J.json_items(spark, str(folder), "item").count() == n, (size, cut)
    (tmp_path / "late").mkdir()
    (tmp_path / "late/f.json").write_text(whole + " } ] junk")
    assert J.json_items(spark, str(tmp_path / "late"), "item").count() == 20


def test_one_item_larger_than_a_range(spark, tmp_path, ranges):
    big = {"a": ["{}" * 5000, {"b": [1, {"c": "]}" * 3000}]}]}
    (tmp_path / "f.json").write_text(json.dumps([{"n": 1}, big, {"n": 2}]))
    ranges(500)
    assert [json.loads(r.item) for r in J.json_items(spark, str(tmp_path), "item").orderBy("start", "number").collect()] == [{"n": 1}, big, {"n": 2}]


def test_law_articles_without_text_or_number_are_left_out(spark, tmp_path, ranges):
    articles = [{"article": "1", "text": "a"}, {"article": "", "text": "a"}, {"article": "2"}, {"text": "x"}, {"article": "3", "text": ""}, {"article": "4", "text": "b", "keywords": ["k"], "order_index": 9}]
    (tmp_path / "f.json").write_text(json.dumps({"law_sources": {"name": "n", "articles": articles}}))
    ranges(30)
    got = J.law_articles(spark, str(tmp_path)).orderBy("article_number").collect()
    assert [(r.article_number, r.content, r.keywords, r.order_index) for r in got] == [("1", "a", None, 0), ("4", "b", ["k"], 9)]


def test_conversations_as_one_array_in_many_ranges(spark, sf, tmp_path, ranges):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    J.write_arrays(rows.coalesce(1), str(tmp_path / "c"))
    ranges(4096)
    parts = J.json_items(spark, str(tmp_path / "c"), "item")
    assert parts.select("path").distinct().count() == 1 and parts.select("start").distinct().count() > 10
    back = parts.select(F.from_json("item", rows.schema).alias("i")).select("i.*")
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()


def test_empty(spark, tmp_path):
    J.write_arrays(spark.createDataFrame([], "a int").coalesce(1), str(tmp_path / "e"))
    assert J.json_items(spark, str(tmp_path / "e"), "item").count() == 0
    with pytest.raises(ValueError):
        J.json_items(spark, str(tmp_path / "e"), "a.b")
