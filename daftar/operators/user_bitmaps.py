"""Exact distinct users of any stretch of time from a small table: the users of every hour as bitmaps, which can be united where counts can't be added.

The table has a row for each time slice and block of 32,768 user ids: slice, block, users. New events add rows; slices that come in several rows
are united when they are read. Ids are whole numbers; close together they make small tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slices(events: DataFrame, user: str = "user_id", minutes: int = 15) -> DataFrame:
    """slice, block, users: the users of every slice of some minutes (from the full hour, so a divisor of 60). Events without user or time are left out."""
    if 60 % minutes:
        raise ValueError("slices divide the hour")
    hour = F.date_trunc("HOUR", F.col("ts"))
    begin = hour + F.make_dt_interval(mins=(F.floor(F.minute("ts") / minutes) * minutes).cast("int"))
    id_ = F.col(user).cast("long")
    known = events.where(F.col(user).isNotNull() & F.col("ts").isNotNull())
    return known.groupBy(begin.cast("timestamp_ntz").alias("slice"), F.bitmap_bucket_number(id_).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("users"))


def _united(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.groupBy(*by, "block").agg(F.bitmap_or_agg("users").alias("users"))


def distinct_users(table: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row: n_users from start (included) to end (not included), both on bounds of slices."""
    inside = table.where((F.col("slice") >= F.lit(start).cast("timestamp_ntz")) & (F.col("slice") < F.lit(end).cast("timestamp_ntz")))
    return _united(inside).agg(F.coalesce(F.sum(F.bitmap_count("users")), F.lit(0)).alias("n_users"))


def users_over_time(table: DataFrame, bucket: Column) -> DataFrame:
    """bucket, n_users: distinct users by larger buckets of slices, such as days."""
    return _united(table, bucket.alias("bucket")).groupBy("bucket").agg(F.sum(F.bitmap_count("users")).alias("n_users"))


def users_of_last(table: DataFrame, slices_back: int, minutes: int = 15) -> DataFrame:
    """slice, n_users: distinct users of each slice and the slices before it, `slices_back` in all: a sliding window, exact."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    ends = table.select("block", "users", F.explode(F.sequence(F.lit(0), F.lit(slices_back - 1))).alias("i"), F.col("slice").alias("_slice"))
    moved = ends.withColumn("slice", F.col("_slice") + step * F.col("i"))
    return _united(moved, "slice").groupBy("slice").agg(F.sum(F.bitmap_count("users")).alias("n_users"))
