"""Queries on embeddings: nearest rows of one query, boosted similarity, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import vectors
from daftar.operators import retrieval
from daftar.plans.common import Registry, table

R = Registry()
#: A fixed query vector, as of a request.
QUERY = [((7 * i) % 11 - 5) / 10 for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"


@R.add(f"""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {_Q}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), 6) AS score FROM embeddings WHERE label <> 3 ORDER BY score, vec_id LIMIT 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of one request, with a filter."""
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), QUERY, 10, condition=F.col("label") != 3).withColumn("score", F.round("score", 6))


@R.add(f"""SELECT vec_id, round(least(1.0, list_cosine_similarity(embedding::DOUBLE[], {_Q}) * (CASE WHEN label = 1 THEN 1.15 ELSE 1.0 END) * (CASE WHEN vec_id % 2 = 0 THEN 1.10 ELSE 1.0 END)), 6) AS score
FROM embeddings WHERE least(1.0, list_cosine_similarity(embedding::DOUBLE[], {_Q}) * (CASE WHEN label = 1 THEN 1.15 ELSE 1.0 END) * (CASE WHEN vec_id % 2 = 0 THEN 1.10 ELSE 1.0 END)) >= 0.1 ORDER BY round(score, 9) DESC, vec_id LIMIT 15""")
def similar_with_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold after boosts for verified and recent rows."""
    query = spark.createDataFrame([(-1, QUERY)], "query_id long, q array<double>")
    return retrieval.similar(table(spark, sf_dir, "embeddings"), query, 15, 0.1, F.col("label") == 1, F.col("vec_id") % 2 == 0).select("vec_id", F.round("score", 6).alias("score"))


@R.add(f"""SELECT label, count(*) AS n, round(avg((list_cosine_similarity(embedding::DOUBLE[], {_Q}) + 1) / 2), 6) AS mean_cosine01, round(max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS longest FROM embeddings GROUP BY label""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit(QUERY).cast("array<double>")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.cosine01(F.col("embedding"), q)), 6).alias("mean_cosine01"), F.round(F.max(vectors.norm(F.col("embedding"))), 6).alias("longest"))


@R.add(f"""WITH s AS (SELECT CASE label WHEN 0 THEN 'laws' ELSE 'cases' END AS kind, vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM embeddings WHERE label IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE score >= 0.05) SELECT kind, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each of two kinds."""
    query = spark.createDataFrame([(-1, QUERY)], "query_id long, q array<double>")
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.hybrid({"laws": rows.where("label = 0"), "cases": rows.where("label = 1")}, query, 5, 0.05).select("kind", "vec_id", F.round("score", 6).alias("score"), "rank")


@R.add("""SELECT label, count(*) AS total, count(embedding) AS with_vector, round(100.0 * count(embedding) / count(*), 2) AS coverage FROM embeddings GROUP BY label""")
def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_statistics(table(spark, sf_dir, "embeddings"), "label", "embedding")


@R.add()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all documents by hashed words of their whole texts; DuckDB has no xxhash64 of Spark's kind, so tests hold them against brute force."""
    return vectors.hashed_embeddings(table(spark, sf_dir, "documents"), "doc_id", "text", 64, most_words=None)
