"""State changes as DataFrame to DataFrame functions; what is returned is the table's new content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.sources.store import last_of_each


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values where the condition is true; all else as it was."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def updated_rows(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The changed rows alone, as they are after update_where."""
    return rows.where(condition).withColumns(values)


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))


def cascade(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """rows whose parent is not among the deleted."""
    return rows.join(deleted.select(key), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """new rows replace those with their keys and join the others. Of several new rows with one key the last in `order` counts; without an order the greatest, column by column (which columns of maps don't allow)."""
    if order is not None:
        new = last_of_each(new, keys, order)
    else:
        last = F.max(F.struct(*(F.col(c) for c in new.columns if c not in keys), *keys)).alias("_last")
        new = new.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(last).select("_last.*")
    return rows.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*rows.columns))


def patch(rows: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Values of changes that are not null replace those of the row with their keys."""
    fields = [c for c in changes.columns if c not in keys]
    changed = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields))
    joined = rows.join(changed, list(keys), "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def add_to_counters(counters: DataFrame, uses: DataFrame, *keys: str, amount: str = "used") -> DataFrame:
    """Counters with the uses added; counters that weren't there begin at 0."""
    return counters.select(*keys, amount).unionByName(uses.select(*keys, amount)).groupBy(*keys).agg(F.sum(amount).alias(amount))


def used_if_allowed(counters: DataFrame, uses: DataFrame, *keys: str, amount: str = "used", limit: str = "limit") -> DataFrame:
    """Check and increment in one: counters (keys, amount, limit) after the uses (keys, amount), each key's in full or, if it would pass the limit, not at all; with `allowed`. A limit of 0 or null is none."""
    asked = uses.groupBy(*keys).agg(F.sum(amount).alias("_asked"))
    sum_ = F.col(amount) + F.col("_asked")
    allowed = (F.coalesce(limit, F.lit(0)) <= 0) | (sum_ <= F.col(limit))
    return counters.join(asked, list(keys), "left").withColumn("allowed", F.when(F.col("_asked").isNotNull(), allowed)).withColumn(amount, F.when(F.col("allowed"), sum_).otherwise(F.col(amount))).drop("_asked")


def with_revision(revisions: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """revisions (key, revision_number, content) and one further row for each key in content."""
    last = revisions.groupBy(key).agg(F.max("revision_number").alias("_last"))
    more = content.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("revision_number"), "content")
    return revisions.select(key, "revision_number", "content").unionByName(more)


def resolve(tickets: DataFrame, condition: Column, at: Column) -> DataFrame:
    """Resolved tickets keep the time of their first resolution."""
    return tickets.withColumn("resolved_at", F.when(condition, F.coalesce("resolved_at", at)).otherwise(F.col("resolved_at"))).withColumn("status", F.when(condition, "resolved").otherwise(F.col("status")))


def document_status(documents: DataFrame, chunks: DataFrame, key: str = "document_id", analysed: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """indexed where a document was analysed, processed where it has chunks and each has a vector, raw else and where its embedding failed."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n"), F.count("embedding").alias("done"))
    joined = documents.drop("status").join(per, key, "left")
    for name, held in (("_analysed", analysed), ("_failed", failed)):
        joined = joined.join(held.select(key).distinct().withColumn(name, F.lit(True)), key, "left") if held is not None else joined.withColumn(name, F.lit(None).cast("boolean"))
    status = F.when(F.col("_failed"), "raw").when(F.col("_analysed"), "indexed").when(F.col("done") == F.col("n"), "processed").otherwise("raw")
    return joined.withColumn("status", status).drop("n", "done", "_analysed", "_failed")
