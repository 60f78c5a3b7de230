"""Top-k retrieval of vectors with filters, boosts and thresholds, for one query or a stated bounded set of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.vectors import cosine, squared_distance


def nearest(rows: DataFrame, vector: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", condition: Column | None = None) -> DataFrame:
    """The k rows of least squared distance to one vector: id, score (a distance), ties to the smaller id. A top-k, not a sort of all rows."""
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    q = F.lit([float(x) for x in vector]).cast("array<double>")
    kept = rows if condition is None else rows.where(condition)
    return kept.select(id_col, squared_distance(F.col(vector_col), q).alias("score")).orderBy("score", id_col).limit(k)


def checked_request(query: str, top_k: int, threshold: float = 0.6, most: int = 100) -> str:
    """The trimmed query of a request: 3 to 2,000 characters, top_k 1 to `most`, threshold 0 to 1; else ValueError."""
    query = query.strip()
    if not 3 <= len(query) <= 2000:
        raise ValueError("a query has 3 to 2000 characters")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k is 1 to {most}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is 0 to 1")
    return query


#: Rows of a request's queries at most; more are an error, as they are broadcast.
MOST_QUERIES = 10_000


def similar(rows: DataFrame, queries: DataFrame, k: int, threshold: float = 0.6, verified: Column | None = None, recent: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", verified_boost: float = 1.15, recent_boost: float = 1.10, custom: Column | None = None) -> DataFrame:
    """For each query (query_id, q) the k rows of highest boosted cosine: verified_boost times if verified, recent_boost if recent, custom times besides, at most 1.0; the threshold holds after the boosts.

    queries is one request's: more than MOST_QUERIES raise an error; they are broadcast.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"a request has {MOST_QUERIES} queries at most")
    pairs = rows.join(F.broadcast(queries), F.col(id_col) != F.col("query_id"))
    boost = (F.when(verified, verified_boost).otherwise(1.0) if verified is not None else F.lit(1.0)) * (F.when(recent, recent_boost).otherwise(1.0) if recent is not None else F.lit(1.0))
    boost = boost if custom is None else boost * custom
    scored = pairs.select("query_id", id_col, F.least(F.lit(1.0), cosine(F.col(vector_col), F.col("q")) * boost).alias("score")).where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(kinds: dict[str, DataFrame], queries: DataFrame, k: int, threshold: float = 0.6, **options) -> DataFrame:
    """The k best of each kind of rows (laws, cases) for each query: kind, query_id, id, score, rank inside the kind."""
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50 per kind")
    found = [similar(rows, queries, k, threshold, **options).withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()]
    return reduce(DataFrame.unionByName, found)


def suggestions(queries: DataFrame, text: str, partial: str, n: int = 5) -> DataFrame:
    """The n most frequent past queries that contain a part, whatever its case, as typed; ties by text: suggestion, n_times."""
    if not 1 <= len(partial) <= 100 or not 1 <= n <= 20:
        raise ValueError("a part has 1 to 100 characters, n is 1 to 20")
    like = F.contains(F.lower(text), F.lit(partial.lower()))
    return queries.where(like).groupBy(F.col(text).alias("suggestion")).agg(F.count("*").alias("n_times")).orderBy(F.desc("n_times"), "suggestion").limit(n)


def search_statistics(rows: DataFrame, kind: str, embedding: str) -> DataFrame:
    """Per kind: total, with a vector, and the share of those in percent of 2 digits."""
    n, done = F.count("*"), F.count(embedding)
    return rows.groupBy(kind).agg(n.alias("total"), done.alias("with_vector"), F.round(100.0 * done / n, 2).alias("coverage"))


def context(chunks: DataFrame, key: str, content: str, order: str, limit: int = 4000, suffix: str = "...") -> DataFrame:
    """Each key's chunks joined in order by blank lines and cut at `limit` characters with a suffix. Groups are top-k lists."""
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda s: s[content]), "\n\n").alias("context"))
    return joined.withColumn("context", F.when(F.length("context") > limit, F.concat(F.substring("context", 1, limit), F.lit(suffix))).otherwise(F.col("context")))


def reranked(rows: DataFrame, scorer: Column, key: str, id_col: str, k: int = 5, least: int = 4) -> DataFrame:
    """Lists of `least` or more candidates by another score, shorter ones by their own rank; the first k. scorer: any column, such as a model's; see lexical_overlap."""
    n = F.count("*").over(Window.partitionBy(key))
    new = Window.partitionBy(key).orderBy(F.desc(F.when(F.col("_n") >= least, scorer)), "rank", id_col)
    return rows.withColumn("_n", n).withColumn("new_rank", F.row_number().over(new)).where(F.col("new_rank") <= k).drop("_n")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that stand in the text."""
    from daftar.functions.text import words

    q = F.array_distinct(words(F.lower(query)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.lower(text)))) / F.size(q)).otherwise(0.0)
