"""Mixing sources to target weights by weighted fair queueing (operator 8).

Every source's documents stand in a shuffled order, by hash, once for each time they may be taken. A document's virtual finish time is its
source's running total of words up to its end, over the source's target. All documents of all sources, sorted by that time over ranges,
are taken until the total budget is reached, so that each source stands near its target at any moment.

Targets: sources in code point order, null last, weigh WEIGHTS in turn and share `budget` times all words; a target stops at `repeats` times
its source's words, and the excess is shared anew by weight.

Running totals go by buckets of the hash (and ranges of the finish time, between quantiles), whose number follows the number of documents: sums of buckets
first, then rows inside a bucket, so no source, however large, meets in one task. Only (doc_id, source, size) move; texts don't.

Defined results: null and empty texts have size 0 and are taken 0 times; sources whose words are 0 have target 0; a null source is a source;
repeated rows are documents of their own, rows that differ in any column too; reruns agree, as the order is a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.common import discard, small_batches, text_slices, with_own_names, written
from daftar.llm.words import spans

WEIGHTS, BUDGET, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
ROWS_PER_BUCKET = 1 << 15
KNOTS = 64


def row_hash(docs: DataFrame) -> Column:
    """What a row's place in the shuffled order comes from: all of its columns, and which of them are null."""
    plain = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*plain, *(c.isNull() for c in plain))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (row_hash), size: the number of words of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                first = spans(data, offsets)[2]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), rows.column("h"), pa.array(np.diff(first), pa.int64())], names=["doc_id", "source", "h", "size"])

    return small_batches(docs).select("doc_id", "source", row_hash(docs).alias("h"), "text").mapInArrow(run, "doc_id long, source string, h long, size long")


def targets(sized: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target. Sources only, not documents, meet in one window."""
    every = Window.partitionBy()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("total", F.lit(budget) * F.sum("source_size").over(every))
    # The share per weight once all sources with a lower cap per weight are at their caps: the first whose cap is above it and all after it share the rest.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shared = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", left / shared).withColumn("place", F.row_number().over(order))
    per = per.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("place", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _bucket_of(n: int, of: Column) -> Column:
    return F.floor(F.shiftrightunsigned(of, 1) / F.lit(float(2**63)) * n).cast("int")


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[str], size: str) -> DataFrame:
    """rows with the column `upto`, the running sum of size per group in the order of bucket and then `order`, without a group meeting in one task."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(size).alias("own"))
    offsets = sums.select(*(F.col(g).alias(f"_{g}") for g in (*group, bucket)), (F.sum("own").over((Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(bucket)) - F.col("own")).alias("offset"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in (*group, bucket)]
    inside = F.sum(size).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offsets, same).withColumn("upto", inside + F.col("offset")).drop("offset", *(f"_{g}" for g in (*group, bucket)))


def _knots(queue: DataFrame) -> Column:
    """KNOTS quantiles of the column `time`, and its least."""
    return queue.agg(F.percentile_approx("time", [i / KNOTS for i in range(KNOTS + 1)], 100 * KNOTS).alias("knots")).scalar()


def _range_of(knots: Column, n: int) -> Column:
    """About n ranges of the column `time` of about as many rows each: by the quantiles, and evenly between two of them."""
    at = F.least(F.greatest(F.size(F.filter(knots, lambda k: k <= F.col("time"))), F.lit(1)), F.lit(KNOTS))
    low, high = F.element_at(knots, at), F.element_at(knots, at + 1)
    parts = -(-n // KNOTS)
    inside = F.when(high > low, F.floor((F.col("time") - low) / (high - low) * parts)).otherwise(0)
    return (at * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))).cast("int")


def mix(docs: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, h (row_hash), source, size, source_size, target, copies (times it is taken), taken (words)."""
    sized = written(sizes(docs))
    n = max(16, sized.count() // ROWS_PER_BUCKET + 1)
    goal = written(targets(sized, budget, repeats, weights).withColumnRenamed("source", "_source"))
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = written(_running(rows.withColumn("bucket", _bucket_of(n, F.col("h"))), ["source"], "bucket", ["h", "doc_id"], "size").drop("bucket"))
    discard(sized)
    finish = lambda k: (F.col("upto") + k * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
    queue = placed.select("doc_id", "h", "size", "target", F.explode(F.array(*(F.struct(finish(k).alias("time"), F.lit(k).alias("round")) for k in range(repeats)))).alias("t")).where("t.time is not null and size > 0")
    queue = queue.select("doc_id", "h", "size", "t.time", "t.round")
    queue = queue.withColumn("knots", _knots(queue)).withColumn("range", _range_of(F.col("knots"), n * repeats)).drop("knots")
    total = goal.agg(F.sum("target").alias("total"))
    key = F.struct("time", "h", "doc_id", "round")
    # As doubles carry the targets, half a word decides nothing.
    cut = _running(queue, [], "range", ["time", "h", "doc_id", "round"], "size").withColumn("total", total.scalar()).where(F.col("upto") <= F.col("total") + 0.5).agg(F.max(key).alias("cut"))
    copies = sum((F.when(F.struct(finish(k).alias("time"), "h", "doc_id", F.lit(k).alias("round")) <= F.col("cut"), 1).otherwise(0) for k in range(repeats)), F.lit(0))
    return placed.withColumn("cut", cut.scalar()).withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)).select("doc_id", "h", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, further columns of any name), each row as often as the mix takes it. Rows that agree in all columns are one row here, with the copies of all of them; texts move once."""
    return with_own_names(lambda d: _mixed_documents(d, **options), docs, "_")


def _mixed_documents(docs: DataFrame, **options) -> DataFrame:
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    chosen = mix(docs, **options).where("copies > 0").groupBy(F.col("h").alias("_row"), key.alias("_key")).agg(F.sum("copies").alias("_copies"))
    once = docs.withColumns({"_row": row_hash(docs), "_key": key}).dropDuplicates(["_row", "_key"])
    return once.join(chosen, ["_row", "_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
