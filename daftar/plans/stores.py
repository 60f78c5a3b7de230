"""Queries on what Spark writes from the tables first: JSON files, hash trees, trigram indexes, ranked and keyed tables, bitmaps of users; and displayed names, locks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar.functions import display
from daftar.operators import hash_tree, locks, long_documents, rerank, trigram, user_bitmaps
from daftar.operators.pages import RankedTable
from daftar.plans.common import Registry, table
from daftar.sources import json_items
from daftar.sources.store import KeyedStore, shared_path

R = Registry()


@R.add("SELECT conv_id, turn, role, text FROM conversations WHERE length(text) > 0 AND turn IS NOT NULL")
def ingested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk ingest: all conversations as JSON arrays, read back by byte ranges; items without text or number are left out."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_path(spark, "json")
    json_items.write_arrays(rows, path)
    items = json_items.json_items(spark, path, "item").select(F.from_json("item", rows.schema).alias("i")).select("i.*")
    return items.where("length(text) > 0 and turn is not null")


LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكمنهو"


@R.add(f"""WITH p AS (SELECT p_partkey, string_split(translate(lower(p_name), '{LATIN}', '{ARABIC}'), '') AS c FROM part),
f AS (SELECT p_partkey, list_transform(c, lambda x, i: {{'x': x, 'back': i > 1 AND coalesce(contains('بتثجحخسشصضطظعغفقكمنه', c[i - 1]), false) AND contains('{ARABIC}', x), 'ahead': coalesce(contains('{ARABIC}', c[i + 1]), false) AND contains('بتثجحخسشصضطظعغفقكمنه', x)}}) AS s FROM p)
SELECT p_partkey, p_partkey::VARCHAR || ' ' || reverse(array_to_string(list_transform(s, lambda e: CASE
WHEN e.back AND e.ahead THEN translate(e.x, 'بتثجحخسشصضطظعغفقكمنه', 'ﺒﺘﺜﺠﺤﺨﺴﺸﺼﻀﻄﻈﻌﻐﻔﻘﻜﻤﻨﻬ')
WHEN e.back THEN translate(e.x, '{ARABIC}', 'ﺎﺐﺖﺚﺞﺢﺦﺪﺬﺮﺰﺲﺶﺺﺾﻂﻆﻊﻎﻒﻖﻚﻢﻦﻪﻮ')
WHEN e.ahead THEN translate(e.x, 'بتثجحخسشصضطظعغفقكمنه', 'ﺑﺗﺛﺟﺣﺧﺳﺷﺻﺿﻃﻇﻋﻏﻓﻗﻛﻣﻧﻫ')
ELSE translate(e.x, '{ARABIC}', 'ﺍﺏﺕﺙﺝﺡﺥﺩﺫﺭﺯﺱﺵﺹﺽﻁﻅﻉﻍﻑﻕﻙﻡﻥﻩﻭ') END), '')) AS shown FROM f""")
def displayed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in Arabic letters with their number, joined and in the order in which they are displayed: the number, left to right, then stands left of the name, right to left."""
    name = F.translate(F.lower("p_name"), LATIN, ARABIC)
    return table(spark, sf_dir, "part").select("p_partkey", display.displayed(F.concat_ws(" ", display.reshaped(name), F.col("p_partkey").cast("string"))).alias("shown"))


@R.add("""SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_a_only, count(*) FILTER (WHERE NOT a AND b) AS n_b_only
FROM (SELECT bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT doc_id, 1 AS s FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id)""")
def reconciled_by_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.reconciliation(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@R.add("""SELECT o_orderkey, 'a' AS side FROM orders WHERE o_orderkey % 997 = 0 UNION ALL SELECT -l_orderkey, 'b' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)""")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one of two nearly equal tables alone has."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    more = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount = 0").select((-F.col("l_orderkey")).alias("o_orderkey"))
    return hash_tree.differences(orders, orders.where("o_orderkey % 997 <> 0").unionByName(more), "o_orderkey")


@R.add("SELECT doc_id, lang FROM documents WHERE text ILIKE '%ation%' OR source ILIKE '%ation%'")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text or source contains a term, by the index of trigrams."""
    rows, path = table(spark, sf_dir, "documents"), shared_path(spark, "trigrams")
    trigram.write_index(rows, "doc_id", ["text", "source"], path)
    return trigram.search(rows, "doc_id", ["text", "source"], "aTion", path).select("doc_id", "lang")


@R.add("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%old_wid%' OR p_type ILIKE '%old_wid%' OR p_name ILIKE '%red%get%' OR p_type ILIKE '%red%get%'")
def part_search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by two terms with wildcards."""
    rows, path = table(spark, sf_dir, "part"), shared_path(spark, "trigrams")
    trigram.write_index(rows, "p_partkey", ["p_name", "p_type"], path)
    found = [trigram.search(rows, "p_partkey", ["p_name", "p_type"], t, path).select("p_partkey", "p_name", "p_type") for t in ("old_wid", "Red%get")]
    return found[0].unionByName(found[1]).distinct()


@R.add("""SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET (SELECT (count(*) - 1) // 20 * 20 FROM lineitem)""")
def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of all lines, from the range it lies in."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ranked = RankedTable(spark, shared_path(spark, "ranked"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).create(rows)
    return ranked.page(ranked.pages(20), 20)


@R.add("""WITH n AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 10 = 0),
u AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)
SELECT c_custkey, c_name, CASE WHEN c_custkey % 75 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM u WHERE c_custkey % 30 <> 0""")
def stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed store after an upsert (of two new rows of a key the later counts), a patch and a delete."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    store = KeyedStore(spark, shared_path(spark, "store"), ["c_custkey"], 16).create(rows)
    some, suppliers = rows.where("c_custkey % 50 = 0"), table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0")
    changed = some.select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("at"))
    more = suppliers.select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.lit(1).alias("at"))
    store.upsert(some.withColumn("at", F.lit(1)).unionByName(changed).unionByName(more), F.col("at"))
    store.patch(rows.where("c_custkey % 75 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(0.0).alias("c_acctbal")), F.lit(1))
    store.delete(store.rows().where("c_custkey % 30 = 0").select("c_custkey"))
    return store.rows()


@R.add("""SELECT 'hour' AS stretch, count(DISTINCT user_id) AS n_users FROM events WHERE ts >= TIMESTAMP '2024-01-10 08:00:00' AND ts < TIMESTAMP '2024-01-10 09:00:00' UNION ALL
SELECT 'day', count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' UNION ALL
SELECT 'all', count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2100-01-01'""")
def users_of_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of several stretches of time, from the table of bitmaps alone."""
    path = shared_path(spark, "users")
    user_bitmaps.slices(table(spark, sf_dir, "events")).write.parquet(path)
    held = spark.read.parquet(path)
    stretches = {"hour": (datetime(2024, 1, 10, 8), datetime(2024, 1, 10, 9)), "day": (datetime(2024, 1, 10), datetime(2024, 1, 11)), "all": (datetime(2000, 1, 1), datetime(2100, 1, 1))}
    found = [user_bitmaps.distinct_users(held, *s).select(F.lit(n).alias("stretch"), "n_users") for n, s in stretches.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@R.add("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def users_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of every day, united from the bitmaps of quarters of an hour."""
    return user_bitmaps.users_over_time(user_bitmaps.slices(table(spark, sf_dir, "events")), F.date_trunc("DAY", "slice").cast("timestamp_ntz"))


@R.add("""WITH s AS (SELECT DISTINCT date_trunc('hour', ts) + to_minutes((floor(minute(ts) / 15) * 15)::INT) AS slice, user_id FROM events),
m AS (SELECT slice + to_minutes((15 * i)::INT) AS slice, user_id FROM s, range(4) r(i))
SELECT slice, count(DISTINCT user_id) AS n_users FROM m GROUP BY slice""")
def users_of_last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact users of the hour that ends with each quarter of an hour."""
    return user_bitmaps.users_of_last(user_bitmaps.slices(table(spark, sf_dir, "events")), 4)


@R.add("""WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, 0::BIGINT AS i, 0 AS n, NULL::TIMESTAMP AS last, NULL::TIMESTAMP AS locked_at, NULL::TIMESTAMP AS until FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT t.user_id, t.i, CASE WHEN away THEN n WHEN NOT bad THEN 0 WHEN k >= 2 THEN 0 ELSE k END, CASE WHEN away OR NOT bad THEN last ELSE ts END, CASE WHEN NOT away AND bad AND k >= 2 THEN ts END, CASE WHEN NOT away AND bad AND k >= 2 THEN ts + INTERVAL 12 HOUR ELSE until END
FROM (SELECT e.*, s.n, s.last, s.until, coalesce(ts < s.until, false) AS away, CASE WHEN s.n > 0 AND ts < s.last + INTERVAL 24 HOUR THEN s.n ELSE 0 END + 1 AS k FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) t)
SELECT user_id, locked_at, locked_at + INTERVAL 12 HOUR AS locked_until FROM s WHERE locked_at IS NOT NULL""")
def locked_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lock of 12 hours after two failures without a signup between."""
    attempts = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return locks.locked(attempts, F.col("event_type") == "error", 2, 12 * 60)


@R.add(r"""WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT lang, doc_id * 1000000 + i AS line_number, CASE WHEN i = 1 AND doc_id % 17 = 0 THEN 'chapter' WHEN i = 1 AND doc_id % 5 = 0 THEN 'section' WHEN i = 1 THEN 'article' ELSE 'content' END AS kind FROM l),
p AS (SELECT *, max(CASE WHEN kind = 'chapter' THEN line_number END) OVER w AS chapter_id, max(CASE WHEN kind = 'section' THEN line_number END) OVER w AS s, max(CASE WHEN kind = 'article' THEN line_number END) OVER w AS a FROM k WINDOW w AS (PARTITION BY lang ORDER BY line_number ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN s > chapter_id THEN s END AS section_id FROM p)
SELECT lang, line_number, chapter_id, section_id, CASE WHEN a > greatest(coalesce(section_id, 0), coalesce(chapter_id, 0)) THEN a END AS article_id FROM q""")
def one_long_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a language as one document, each text an article, section or chapter by its number: the place of every line, by ranges of lines."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    kind = F.when((F.col("i") == 0) & (F.col("doc_id") % 17 == 0), "chapter").when((F.col("i") == 0) & (F.col("doc_id") % 5 == 0), "section").when(F.col("i") == 0, "article").otherwise("content")
    rows = lines.select("lang", (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("line_number"), kind.alias("kind"))
    return long_documents.placed(rows, "lang", 50_000_000).select("lang", "line_number", "chapter_id", "section_id", "article_id")


@R.add()
def reranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the five best of its labelled documents by a scorer of their quality, fitted on all labels; its sums of logistic functions are no SQL of few lines, so tests hold it against the scorer in plain Python."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null").dropDuplicates(["doc_id"])
    path = shared_path(spark, "features")  # the features are computed once, beside the texts; what is joined and read again is small
    docs.where("text is not null").select("doc_id", "source", quality_features(F.col("text")).alias("features")).join(labels, "doc_id").select("doc_id", "source", "quality", "features").write.parquet(path)
    known = spark.read.parquet(path)
    model = rerank.fitted(known, "features", "quality", 4)
    ranks = known.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return rerank.rerank(ranks, "features", model, 4, "source", "doc_id").select("source", "doc_id", "new_rank", F.round("score", 9).alias("score"))


def quality_features(text):
    """Of a text: the logarithm of its words, their mean length, and the shares of different words and of letters and spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    return F.array(F.log(n), chars / n, F.size(F.array_distinct(words)) / n, F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / chars)
