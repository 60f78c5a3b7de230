"""Queries on events: buckets, sessions, logins, quotas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar.functions.text import FEATURE_LIMITS
from daftar.operators import analytics, dml
from daftar.plans.common import Registry, table

R = Registry()
AS_OF = datetime(2024, 1, 20, 12)


@R.add("""SELECT date_trunc('hour', ts) + to_minutes((floor(minute(ts) / 45) * 45)::INT) AS bucket, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def users_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.users_over_time(table(spark, sf_dir, "events"), 45)


@R.add("SELECT count(DISTINCT user_id) AS n_online FROM events WHERE ts > TIMESTAMP '2024-01-20 11:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def users_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.online(table(spark, sf_dir, "events"), AS_OF, 60)


@R.add("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS last_seen, count(*) AS n_events FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_events")


@R.add("""SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-19 12:00:00' THEN user_id END) AS active_last_day FROM events""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.dashboard(table(spark, sf_dir, "events"), AS_OF)


@R.add("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


@R.add("""WITH f AS (SELECT * FROM events WHERE event_type IN ('error', 'click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')
SELECT event_id, user_id, event_type, ts FROM f ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20""")
def event_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered log, newest first."""
    from daftar.operators.catalog import page, where_given

    kept = where_given(table(spark, sf_dir, "events"), event_type=["error", "click"], ts=(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")), user_id=None)
    return page(kept, [F.desc("ts"), "event_id"], 2, 20).select("event_id", "user_id", "event_type", "ts")


@R.add("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "ts")


@R.add("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
p AS (SELECT user_id, run, count(*) FILTER (WHERE event_type = 'error') AS n FROM r GROUP BY ALL)
SELECT user_id, max(n) AS longest_run, max(n) >= 3 AS locked FROM p GROUP BY user_id""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of failures per user."""
    return analytics.lockouts(table(spark, sf_dir, "events"), F.col("event_type") == "error", 3)


@R.add("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS used, (user_id % 5) * 5 AS lim FROM events GROUP BY user_id)
SELECT user_id, used, CASE WHEN lim > 0 THEN greatest(lim - used, 0) END AS remaining, lim = 0 OR used < lim AS can_use, CASE WHEN lim > 0 THEN round(100.0 * used / lim, 2) ELSE 0 END::DOUBLE AS percent FROM u""")
def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use against a limit per user; a limit of 0 is none."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n")).withColumn("lim", (F.col("user_id") % 5) * 5)
    return used.select("user_id", analytics.quota(F.col("n"), F.col("lim")).alias("q")).select("user_id", "q.*")


@R.add("""SELECT round(avg(r), 6) AS macro_accuracy, count(r) AS n_keys FROM (SELECT user_id, avg((event_type = 'purchase')::INT::DOUBLE) AS r FROM events GROUP BY user_id)""")
def macro_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over users of each one's share of purchases."""
    return analytics.macro_accuracy(table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "purchase"), "user_id", "hit")


@R.add("""SELECT user_id, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return events.groupBy("user_id", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@R.add("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_value FROM events""")
def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number and total in each user's order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("event_index"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_value"))


@R.add("""SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup,
lead(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events""")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup so far and the next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", "event_type", last.alias("last_signup"), F.lead("event_id", 1, -1).over(w).alias("next_event"))


@R.add("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error' OR event_type IS NULL) AS failed FROM events GROUP BY user_id""")
def event_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, successful and failed events of every user."""
    return analytics.tally(table(spark, sf_dir, "events"), F.col("event_type") != "error", "user_id")


@R.add("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey AS subscription_id, (o_custkey % 7)::INT AS plan_id, o_orderdate AS start_date, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 400 DAY END AS end_date FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, subscription_id DESC) AS rn FROM s WHERE start_date <= TIMESTAMP '1998-01-01' AND (end_date IS NULL OR end_date > TIMESTAMP '1998-01-01')),
p AS (SELECT n_nationkey AS plan_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 40 END AS ai_message_limit FROM nation WHERE n_nationkey < 6),
u AS (SELECT l_orderkey AS subscription_id, sum(l_quantity)::BIGINT AS used FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
j AS (SELECT a.user_id, p.plan_id IS NOT NULL AS has, coalesce(p.ai_message_limit, 0) AS lim, coalesce(u.used, 0) AS used FROM (SELECT DISTINCT user_id FROM s) a LEFT JOIN c ON a.user_id = c.user_id AND c.rn = 1 LEFT JOIN p ON c.plan_id = p.plan_id LEFT JOIN u ON c.subscription_id = u.subscription_id)
SELECT user_id, CASE WHEN has THEN used ELSE 0 END::BIGINT AS current_usage, lim::INT AS "limit", CASE WHEN NOT has THEN 0 WHEN lim > 0 THEN greatest(0, lim - used) ELSE 999999 END::BIGINT AS remaining, has AND (lim = 0 OR used < lim) AS can_use FROM j""")
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest valid subscription, plan and usage of every customer in one plan."""
    orders, nations, lines = (table(spark, sf_dir, t) for t in ("orders", "nation", "lineitem"))
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(days=F.lit(400)))
    held = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("subscription_id"), (F.col("o_custkey") % 7).cast("int").alias("plan_id"), F.col("o_orderdate").alias("start_date"), end.alias("end_date"))
    none = [F.lit(0).alias(c) for c in FEATURE_LIMITS.values() if c != "ai_message_limit"]
    plans = nations.where("n_nationkey < 6").select(F.col("n_nationkey").alias("plan_id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 40).alias("ai_message_limit"), *none)
    used = lines.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("subscription_id"), F.lit("ai_chat").alias("feature"), F.col("l_quantity").cast("long").alias("used_count"))
    return analytics.feature_usage(held, plans, used, "ai_chat", F.lit("1998-01-01").cast("timestamp_ntz"))


@R.add("""WITH c AS (SELECT user_id, count(*) AS used, (user_id % 4) * 10 AS lim FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), n AS (SELECT user_id, count(*) AS asked FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'view' GROUP BY user_id)
SELECT user_id, CASE WHEN asked IS NOT NULL AND (lim <= 0 OR used + asked <= lim) THEN used + asked ELSE used END AS used, lim AS "limit", CASE WHEN asked IS NOT NULL THEN lim <= 0 OR used + asked <= lim END AS allowed FROM c LEFT JOIN n USING (user_id)""")
def allowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after uses that their limits allow."""
    events, half = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    counters = events.where(F.col("ts") < half).groupBy("user_id").agg(F.count("*").alias("used")).withColumn("limit", (F.col("user_id") % 4) * 10)
    uses = events.where((F.col("ts") >= half) & (F.col("event_type") == "view")).select("user_id", F.lit(1).alias("used"))
    return dml.used_if_allowed(counters, uses, "user_id")
