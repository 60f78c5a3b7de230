"""Pages of a large table at any depth: the table is written in ranges of its order, with a count for each, so that a page reads the one or two ranges it lies in, and the total comes from the counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RankedTable:
    """A table in ranges of a total order. The ranges' bounds are quantiles that Spark samples; counts are exact. Rows that are equal in the order lie in one range, so an order that many rows share makes a large range."""

    RANGE = "_range"

    def __init__(self, spark: SparkSession, path: str, order: Sequence[Column | str]) -> None:
        self.spark, self.path, self.order = spark, path, list(order)
        self._counts: list[tuple[int, int]] | None = None

    def create(self, rows: DataFrame, ranges: int = 64) -> RankedTable:
        dealt = rows.repartitionByRange(ranges, *self.order).sortWithinPartitions(*self.order).withColumn(self.RANGE, F.spark_partition_id())
        dealt.write.partitionBy(self.RANGE).parquet(f"{self.path}/rows")
        dealt.limit(0).write.parquet(f"{self.path}/schema")  # for tables without rows
        self._stored().groupBy(self.RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/counts")
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def counts(self) -> list[tuple[int, int]]:
        """(range, rows) in order: one small row a range."""
        if self._counts is None:
            self._counts = sorted((r[0], r[1]) for r in self.spark.read.parquet(f"{self.path}/counts").collect())
        return self._counts

    def total(self) -> int:
        return sum(n for _, n in self.counts())

    def pages(self, size: int) -> int:
        return math.ceil(self.total() / size)

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1). Of the ranges only those are read that the page lies in."""
        if number < 1 or size < 1:
            raise ValueError("page and size count from 1")
        first, last, before, wanted, skipped = (number - 1) * size, number * size, 0, [], 0
        for r, n in self.counts():
            if before < last and before + n > first:
                skipped = skipped if wanted else first - before
                wanted.append(r)
            before += n
        rows = self._stored().where(F.col(self.RANGE).isin(*wanted) if wanted else F.lit(False)).drop(self.RANGE)
        return rows.orderBy(*self.order).offset(skipped).limit(size)
