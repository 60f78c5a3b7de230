"""The corpus pipeline: documents without toxic ones, one of each near-duplicate group, without repeated passages, mixed to target weights, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import bpe, jaccard_join, mixing, substring_dedup, toxicity
from daftar.llm.common import written
from daftar.llm.queries import BYTE_BPE, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, row by row. The labels are those of the corpus."""
    return toxicity.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at a Jaccard similarity of 0.8 on five-word shingles: that of the smallest id, of rows with this id one whose text hashes lowest.

    Rows with one id are judged each by its own text; rows that repeat id and text are one component. Rows without an id and texts without words are linked with nothing and stay.
    """
    rows = jaccard_join.join(docs, width=5, percent=80, text_hash=True).where("component is not null").select("doc_id", "text_hash", "component")
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash").distinct()
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    once = docs.where(linked).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
    return once.join(kept, ["doc_id", "text_hash"], "left_semi").select(*COLUMNS).unionByName(docs.where(~linked).select(*COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts cut to the words that no passage of 50 words repeats from a document with a smaller id. All documents stay, if with an empty text."""
    kept = substring_dedup.remove(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are taken 0 times."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded, one row for each row."""
    return bpe.encode_documents(docs, BYTE_BPE)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("bpe", as_tokens),
]

#: The stages have learned, hashed and tokenized steps that SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
