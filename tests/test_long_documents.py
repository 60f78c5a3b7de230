"""Documents by ranges of lines against the window forms, and reranking against the scorer in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.operators import hierarchy, long_documents, rerank
from daftar.plans import stores

LINES = ["الباب الأول .... 3", "الفصل الثاني 5", "المادة الأولى", "المادة 5: نص", "text", "", "x" * 120, "فهرس المحتويات", "Chapter الباب الأول", "Chapter one", "12", "أولاً تمهيد", "الباب الثالث", "المادة الثانية .. 9", "long enough text of a paragraph that follows a heading, more than fifty"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    rows = []
    for d in range(12):
        pool = rng.sample(LINES, rng.randint(3, len(LINES)))
        rows += [(None if d == 11 else d, i + 1, rng.choice(pool)) for i in range(rng.randint(1, 260))]
    return spark.createDataFrame(rows, "doc_id long, line_number long, line string").repartition(5).cache()


def rows(df, *columns):
    return sorted(str(tuple(r[c] for c in ("doc_id", "line_number", *columns))) for r in df.collect())


@pytest.mark.parametrize("size", [15, 16, 50, 1000])
def test_ranges_equal_whole_documents(lines, size):
    k = hierarchy.classified(lines)
    parts = "chapter_id", "section_id", "article_id"
    assert rows(long_documents.placed(k, size=size), *parts) == rows(hierarchy.placed(k), *parts)
    found = long_documents.contents_lines(lines, size=size)
    assert sorted(found.columns) == sorted([*lines.columns, "in_contents"])
    assert rows(found, "in_contents") == rows(hierarchy.contents_lines(lines), "in_contents")


def test_ranges_are_many_tasks(spark):
    long = spark.range(1, 200_001).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_number"), F.when(F.col("id") % 7000 == 1, "chapter").otherwise("content").alias("kind"))
    out = long_documents.placed(long, size=1000)
    assert out.where("chapter_id = line_number - (line_number - 1) % 7000").count() == 200_000
    held = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 150_000
    with pytest.raises(ValueError):
        long_documents.contents_lines(long.withColumn("line", F.lit("x")), size=5)


def test_rerank(spark):
    rng = random.Random(5)
    pairs = [([rng.gauss(0, 1), rng.gauss(5, 3)], 0) for _ in range(300)] + [([rng.gauss(1.5, 1), rng.gauss(4, 3)], 1) for _ in range(300)]
    pairs += [([1.0], 1), ([None, 1.0], 0), ([float("nan"), 1.0], 1), ([1.0, 1.0], None)]
    model = rerank.fitted(spark.createDataFrame(pairs, "x array<double>, y int"), "x", "y", 2)
    scorer = rerank.loaded(model)
    x, y = np.array([p[0] for p in pairs[:600]]), np.array([p[1] for p in pairs[:600]])
    assert ((scorer(x) > 0.5) == y).mean() > 0.75
    held = np.load(__import__("io").BytesIO(model))
    p, z = scorer(x), np.c_[np.ones(600), (x - held["mean"]) / held["deviation"]]
    assert np.abs(z.T @ (p - y) + np.r_[0, held["weights"][1:]]).max() < 1e-6  # the loss is least here
    lists = {q: [(q, q * 100 + i, i + 1, [rng.gauss(0, 1), rng.gauss(5, 3)]) for i in range(n)] for q, n in ((1, 3), (2, 4), (3, 30), (4, 1))}
    df = spark.createDataFrame([r for rs in lists.values() for r in rs], "q long, id long, rank int, x array<double>").repartition(3)
    got = {}
    for r in rerank.rerank(df, "x", model, 2, "q", "id").orderBy("q", "new_rank").collect():
        got.setdefault(r.q, []).append(r.id)
    for q, rs in lists.items():
        by_model = sorted(rs, key=lambda r: (-float(scorer(np.array([r[3]]))[0]), r[2]))
        assert got[q] == [r[1] for r in (rs if len(rs) <= 3 else by_model)[:5]]


def test_model_is_read_once_a_worker(spark, tmp_path):
    """The model is made ready by worker, not by batch or row."""
    model = rerank.fitted(spark.createDataFrame([([1.0], 1), ([0.0], 0)] * 5, "x array<double>, y int"), "x", "y", 1)
    rows_ = spark.range(5000).select(F.array((F.col("id") % 7).cast("double")).alias("x")).repartition(2)
    assert rows_.select(rerank.model_score(F.col("x"), model, 1, batch=10).alias("s")).where("s between 0 and 1").count() == 5000


def test_features_are_computed_once(spark):
    """A fit reads the features of its pairs in every step, and computes them in none but the first."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def features(i):
        seen.add(1)
        return [float(i % 7)]

    rerank.fitted(spark.range(200).select(features("id").alias("x"), (F.col("id") % 2).alias("y")).repartition(2), "x", "y", 1)
    assert 200 <= seen.value <= 400


def test_reranked_documents(spark, sf):
    """The registered query against the scorer in plain Python."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").collect() if d.doc_id in labels and d.text is not None]
    features = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "i long, t string").select("i", stores.quality_features(F.col("t")).alias("x"))
    x = {r.i: r.x for r in features.collect()}
    for d in docs[:50]:
        w = d.text.split()
        assert abs(x[d.doc_id][0] - np.log(max(1, len(w)))) < 1e-9 and abs(x[d.doc_id][2] - len(set(w)) / max(1, len(w))) < 1e-9
    model = rerank.fitted(spark.createDataFrame([(x[d.doc_id], labels[d.doc_id]) for d in docs], "x array<double>, y int"), "x", "y", 4)
    score = {i: float(rerank.loaded(model)(np.array([v]))[0]) for i, v in x.items()}
    lists, got = {}, {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        lists.setdefault(d.source, []).append(d.doc_id)
    for r in stores.reranked_documents(spark, sf).orderBy("new_rank").collect():
        assert abs(r.score - score[r.doc_id]) < 1e-6
        got.setdefault(r.source, []).append(r.doc_id)
    assert set(got) == set(lists)
    for source, ids in lists.items():
        want = ids if len(ids) <= 3 else sorted(ids, key=lambda i: -score[i])
        assert got[source] == want[:5]
