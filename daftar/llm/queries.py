"""The registered queries of the training-data operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import ann, bpe, exact_topk, html_text, jaccard_join, lexical_search, mixing, periodic_runs, substring_dedup, suffix_dedup, toxicity, url_rules, wavelet

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 neighbours of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.85 on 4-word shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

OP4_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
n AS (SELECT row_number() OVER () AS i, * FROM p),
b AS (
  SELECT i, any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rh || rp, length(rh || rp)) FILTER (WHERE rh IS NOT NULL) AS rule,
         arg_max(v, length(rh || rp)) FILTER (WHERE rh IS NOT NULL) AS v
  FROM n LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; urls that no rule fits are allowed."""
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.rules_frame(pages, URL_RULES), default="allow")


def op5_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document as parts of passages that begin in a document with a smaller id."""
    return substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op7_token_id_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as wavelet-matrix files and reads them back."""
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), WORD_BPE))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 highest integer inner products of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The texts that operator 11 is asked about: of one in ten documents (by crc32 of the id) the words from word a = g % n on repeat with period 1 + floor((n - a) / (3 + g % 8)), g = floor(crc32 / 10)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % period).otherwise(i).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.filter(F.array(words), lambda w: F.size(w) > 0)  # a variable, so that the words are found once
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(some, planted), 0), text)).otherwise(text)


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of runs, the longest, and digests of all runs and of the text without repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.collapse(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "n_runs", longest.alias("k"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("k.less")
    return found.select(
        "doc_id", "n_runs", F.col("k.start").alias("start"), length.alias("length"), F.col("k.period").alias("period"),
        F.floor(1000 * length / F.col("k.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


OP12_SQL = r"""
WITH w AS (
  SELECT r, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(floor(1000 * ln((2 * c.N + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * d.n * c.N) // c.L))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r) CROSS JOIN c GROUP BY item_id, r
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document as parts of strings of 50 bytes that start in a document with a smaller id."""
    return suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_approximate_nearest_neighbours": op1_approximate_nearest_neighbours,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filters": op4_url_filters,
    "op5_bpe_encoding_and_decoding": op5_bpe_encoding_and_decoding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_id_binary_output": op7_token_id_binary_output,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_exact_top_k_search": op9_exact_top_k_search,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_run_detection": op11_periodic_run_detection,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": OP4_SQL, "op9_exact_top_k_search": OP9_SQL, "op12_ranked_lexical_search": OP12_SQL}
