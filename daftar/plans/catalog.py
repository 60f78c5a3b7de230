"""Queries on the relational tables: filters, pages, joins, aggregates, set operations, state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import catalog, dml, retrieval
from daftar.operators.analytics import percentage
from daftar.plans.common import Registry, table

R = Registry()


@R.add("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 8000 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40""")
def customer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = catalog.where_given(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_acctbal=(1000, 8000), c_nationkey=None)
    return catalog.page(kept, [F.desc("c_acctbal"), "c_custkey"], 3, 20).select("c_custkey", "c_name", "c_acctbal")


@R.add("SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 8000")
def customer_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = catalog.where_given(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_acctbal=(1000, 8000))
    return catalog.total(kept).withColumn("pages", F.ceil(F.col("total") / 20))


@R.add("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%'")
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(catalog.contains_any(["p_name", "p_brand", "p_type"], "ReD")).select("p_partkey", "p_name", "p_brand", "p_type")


@R.add("""SELECT * FROM (SELECT p_partkey, p_type, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) WHERE p_type = 'ECONOMY'""")
def filter_after_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filter_after_page(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 1, 100, F.col("p_type") == "ECONOMY")


@R.add("""SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog.where_given(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"])
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "o_totalprice")


@R.add("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
CASE WHEN count(o_orderkey) > 0 THEN round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(o_orderkey), 2) ELSE 0 END::DOUBLE AS percent_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def customer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts in one pass over orders, aggregated before the join."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    out = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(per, "c_custkey", "left").fillna(0, ["n_orders", "total", "n_open"])
    return out.withColumn("percent_open", percentage(F.col("n_open"), F.col("n_orders")))


@R.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.add("""SELECT o_orderkey, list({'l_linenumber': l_linenumber, 'l_quantity': l_quantity} ORDER BY l_linenumber, l_quantity) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey""")
def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as one ordered array."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return catalog.children(orders, lines, "o_orderkey", "l_linenumber", "lines").where("size(lines) > 0")


@R.add("""SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_a_only, count(*) FILTER (WHERE NOT a AND b) AS n_b_only
FROM (SELECT bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT doc_id, 1 AS s FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id)""")
def reconciled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reconciliation(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@R.add("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@R.add("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@R.add("""SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events""")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, (table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "orders", "documents", "events")))


@R.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def expired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk update by condition."""
    rows = table(spark, sf_dir, "orders")
    return dml.update_where(rows, (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), o_orderstatus=F.lit("X")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@R.add("""SELECT c_custkey, c_name || '*' AS c_name, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT s_suppkey + 10000000, s_name || '*', -s_acctbal FROM supplier""")
def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert by key: some keys exist, some don't."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    new = rows.where("c_custkey % 10 = 0").unionByName(more).select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (-F.col("c_acctbal")).alias("c_acctbal"))
    return dml.upsert(rows, new, "c_custkey")


@R.add("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch whose null values change nothing."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.when(F.col("c_acctbal") > 5000, "rich").alias("c_mktsegment"))
    return dml.patch(rows, changes, "c_custkey")


@R.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def lines_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cascading delete leaves of the children."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.cascade(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@R.add("SELECT o_custkey, coalesce(max(year(o_orderdate)), 0) + 1 AS next_number FROM orders GROUP BY o_custkey")
def next_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daftar.operators.analytics import next_number

    return next_number(table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "y")


@R.add("""SELECT user_id, event_type, sum(used) AS used FROM (SELECT user_id, event_type, count(*) AS used FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL UNION ALL SELECT user_id, event_type, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-15') GROUP BY ALL""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with later uses added."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.lit(1).cast("long").alias("used"))
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    before = events.where(F.col("ts") < day).groupBy("user_id", "event_type").agg(F.sum("used").alias("used"))
    return dml.add_to_counters(before, events.where(F.col("ts") >= day), "user_id", "event_type")


@R.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@R.add("""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS end_date FROM orders) SELECT o_orderkey FROM e WHERE end_date IS NULL OR end_date > TIMESTAMP '1998-01-01'""")
def open_ended_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an end or with one that is still to come."""
    ends = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("end_date"))
    return ends.where(catalog.null_or_after("end_date", F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@R.add("""SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['cold', 'red', 'widget'])""")
def tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with any of some tags."""
    tags = F.to_json(F.split("p_name", " "))
    return table(spark, sf_dir, "part").where(catalog.has_any(catalog.tags_of(tags), ["cold", "red", "widget"])).select("p_partkey")


@R.add("""SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) ORDER BY o_totalprice DESC, o_orderkey OFFSET 20""")
def limited_then_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.limited_then_skipped(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), (F.desc("o_totalprice"), "o_orderkey"), 20, 50)


@R.add("""SELECT o_orderkey, coalesce(c_name, 'Unknown') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer's name, or a default where that customer isn't listed."""
    names = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return catalog.labelled(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, F.col("o_custkey") == F.col("c_custkey"), "c_name").select("o_orderkey", "c_name")


@R.add("""SELECT l_orderkey, l_linenumber, c_name || ' ' || n_name AS who, p_name FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def chained_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left lookups, one of them chained; the name is null unless both of its parts are there."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    parts = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = joined.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", catalog.both_or_null("c_name", "n_name").alias("who"), "p_name")


@R.add("""SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000""")
def changed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an update changes, as they are after it."""
    return dml.updated_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000), o_orderstatus=F.lit("X"))


@R.add("""SELECT p_name AS suggestion, count(*) AS n_times FROM part WHERE contains(lower(p_name), 'red') GROUP BY p_name ORDER BY n_times DESC, suggestion LIMIT 5""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent names that contain what was typed."""
    return retrieval.suggestions(table(spark, sf_dir, "part"), "p_name", "Red", 5)


@R.add("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END AS ts, user_id, event_type, value, props FROM events""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole events with their times as ISO text."""
    return catalog.with_iso_dates(table(spark, sf_dir, "events"))


@R.add("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size = 1 AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 1")
def first_small_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part, by key, that is small and of a type."""
    return catalog.first(table(spark, sf_dir, "part"), (F.col("p_size") == 1) & (F.col("p_type") == "ECONOMY"), "p_partkey").select("p_partkey", "p_name", "p_retailprice")
