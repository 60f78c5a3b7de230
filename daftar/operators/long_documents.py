"""The structure of documents of any number of lines: a segmented scan instead of one window a document.

Lines are cut into ranges of SIZE. Each range is summarised by its last chapter, section and article, or the last place where a contents page begins or ends; the summaries, one
small row a range, are carried over in order; then each range is finished by itself with what the ranges before it left open. So a document's lines are
as many tasks as it has ranges, and what is gathered by document is a row a range. Results equal those of the window forms in hierarchy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.operators import hierarchy

SIZE = 10_000


def _ranged(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("_range", F.floor((F.col("line_number") - 1) / size))


def _before(summaries: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of each range the greatest of each column in the ranges before it; a row a range meets in one window a document."""
    w = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), *(F.max(c).over(w).alias(f"{c}_before") for c in columns))


def _with_before(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of"))).drop("_key", "_of")


def placed(rows: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """hierarchy.placed: classified lines with chapter_id, section_id and article_id. Line numbers grow; they may have gaps."""
    kinds = ("chapter", "section", "article")
    at = {k: F.when(F.col("kind") == k, F.col("line_number")) for k in kinds}
    rows = _ranged(rows, size)
    summaries = rows.groupBy(key, "_range").agg(*(F.max(at[k]).alias(f"_{k}") for k in kinds))
    here = Window.partitionBy(key, "_range").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_before(rows, _before(summaries, key, *(f"_{k}" for k in kinds)), key)
    last = lambda k: F.coalesce(F.max(at[k]).over(here), F.col(f"_{k}_before"))
    out = joined.withColumns({"chapter_id": last("chapter"), "_section": last("section"), "_article": last("article")})
    out = out.withColumn("section_id", F.when(F.col("_section") > F.col("chapter_id"), F.col("_section")))
    start = F.greatest(F.coalesce("section_id", F.lit(0)), F.coalesce("chapter_id", F.lit(0)))
    return out.withColumn("article_id", F.when(F.col("_article") > start, F.col("_article"))).drop("_section", "_article", "_range", *(f"_{k}_before" for k in kinds))


def contents_lines(rows: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """hierarchy.contents_lines: lines with in_contents. Line numbers count from 1 without gaps, as those of hierarchy.lines. A range also sees the first lines of the next one, as far as the rules look ahead."""
    if size < hierarchy.AHEAD:
        raise ValueError(f"ranges have {hierarchy.AHEAD} lines at least")
    ranged = _ranged(rows, size)
    first = (F.col("line_number") - 1) % size < hierarchy.AHEAD - 1
    lent = ranged.where(first & (F.col("_range") > 0)).withColumns({"_range": F.col("_range") - 1, "_lent": F.lit(True)})
    here = Window.partitionBy(key, "_range").orderBy("line_number")
    marks = hierarchy.contents_marks(ranged.withColumn("_lent", F.lit(False)).unionByName(lent), here).where(~F.col("_lent")).drop("_lent")
    turn = F.when(F.col("_ends"), F.struct("line_number", F.lit(False).alias("b"))).when(F.col("_begins"), F.struct("line_number", F.lit(True).alias("b")))
    marks = marks.withColumn("_turn", turn)
    summaries = marks.groupBy(key, "_range").agg(F.max("_turn").alias("_turn"), F.count_if("_prefixed").alias("_n"), F.min(F.when(F.col("_prefixed"), F.col("line_number"))).alias("_from"), F.max(F.when(F.col("_prefixed"), F.col("line_number"))).alias("_to"))
    whole = summaries.groupBy(F.col(key).alias("_doc")).agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    joined = _with_before(marks, _before(summaries, key, "_turn"), key).join(whole, F.col(key).eqNullSafe(F.col("_doc")))
    last: Column = F.coalesce(F.max("_turn").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("_turn_before"))["b"]
    inside = F.when(F.col("_n") >= 3, F.col("line_number").between(F.col("_from"), F.col("_to"))).otherwise(F.coalesce(last, F.lit(False)))
    return joined.withColumn("in_contents", inside).drop("_doc", "_n", "_from", "_to", "_prefixed", "_begins", "_ends", "_turn", "_turn_before", "_range")
