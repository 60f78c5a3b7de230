"""Activity metrics: buckets, online users, sessions, dashboards, quotas, accuracy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.text import plan_limit
from daftar.operators.catalog import null_or_after


def minute_bucket(ts: Column, minutes: int) -> Column:
    """The hour and the minutes of the hour rounded down to a multiple; so 45 gives :00 and :45."""
    hour = F.date_trunc("HOUR", ts)
    return (hour + F.make_dt_interval(mins=(F.floor(F.minute(ts) / minutes) * minutes).cast("int"))).cast("timestamp_ntz")


def users_over_time(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Distinct users by bucket: bucket, n_users."""
    return events.groupBy(minute_bucket(F.col("ts"), minutes).alias("bucket")).agg(F.countDistinct("user_id").alias("n_users"))


def online(events: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    """One row: distinct users seen in the last minutes before as_of."""
    at = F.lit(as_of).cast("timestamp_ntz")
    return events.where((F.col("ts") > at - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") <= at)).agg(F.countDistinct("user_id").alias("n_online"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after `gap` without an event: user_id, start, last_seen, n_events."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.min("ts").alias("start"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events")).drop("session_window")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def dashboard(events: DataFrame, as_of: datetime) -> DataFrame:
    """One row in one scan: n_events, n_users, n_errors, active_last_day."""
    day = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(1))
    return events.agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.countDistinct(F.when(F.col("ts") >= day, F.col("user_id"))).alias("active_last_day"))


def percentage(part: Column, whole: Column) -> Column:
    """Of the whole, in percent of 2 digits; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def quota(used: Column, limit: Column) -> Column:
    """used, remaining, can_use, percent; a limit of 0 or null is none."""
    unlimited = F.coalesce(limit, F.lit(0)) <= 0
    return F.struct(used.alias("used"), F.when(~unlimited, F.greatest(limit - used, F.lit(0))).alias("remaining"), (unlimited | (used < limit)).alias("can_use"), percentage(used, F.coalesce(limit, F.lit(0))).alias("percent"))


def macro_accuracy(hits: DataFrame, key: str, hit: str) -> DataFrame:
    """One row: mean over keys of each key's hit ratio; keys without judged rows don't count."""
    return hits.groupBy(key).agg(F.avg(F.col(hit).cast("double")).alias("ratio")).agg(F.round(F.avg("ratio"), 6).alias("macro_accuracy"), F.count("ratio").alias("n_keys"))


def tally(rows: DataFrame, succeeded: Column, *keys: str) -> DataFrame:
    """total, successful and failed rows, of each key or of all; what is neither true nor false has failed."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(succeeded).alias("successful"), (F.count("*") - F.count_if(succeeded)).alias("failed"))


def next_number(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Each key's next revision number."""
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def feature_usage(subscriptions: DataFrame, plans: DataFrame, usage: DataFrame, feature: str, as_of: Column) -> DataFrame:
    """Each user's quota of a feature: user_id, current_usage, limit, remaining (999999 without a limit), can_use. The latest subscription that has begun and not ended counts; without one nothing is allowed, without a limit (0) or a usage row everything is."""
    valid = subscriptions.where((F.col("start_date") <= as_of) & null_or_after("end_date", as_of))
    current = latest(valid, "user_id", F.desc("start_date"), F.desc("subscription_id")).select("user_id", "subscription_id", "plan_id")
    limits = plans.select("plan_id", plan_limit(F.lit(feature)).alias("limit"))
    used = usage.where(F.col("feature") == feature).groupBy("subscription_id").agg(F.sum("used_count").alias("used_count"))
    joined = subscriptions.select("user_id").distinct().join(current, "user_id", "left").join(limits, "plan_id", "left").join(used, "subscription_id", "left")
    has, now, most = F.col("limit").isNotNull(), F.coalesce("used_count", F.lit(0)), F.coalesce("limit", F.lit(0))
    return joined.select("user_id", F.when(has, now).otherwise(0).alias("current_usage"), most.alias("limit"), F.when(~has, 0).when(most > 0, F.greatest(F.lit(0), most - now)).otherwise(999999).alias("remaining"), (has & ((most == 0) | (now < most))).alias("can_use"))


def lockouts(attempts: DataFrame, failed: Column, most: int = 5) -> DataFrame:
    """Per user the longest run of failures without a success between, and whether it reaches `most`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = attempts.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    per_run = run.groupBy("user_id", "_run").agg(F.count_if(failed).alias("n"))
    return per_run.groupBy("user_id").agg(F.max("n").alias("longest_run"), (F.max("n") >= most).alias("locked"))
