"""Queries on documents and conversations: hashes, chunks, keywords, cleaning, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import chunking, text
from daftar.operators import hierarchy
from daftar.plans.common import Registry, table

R = Registry()


@R.add("SELECT doc_id, sha256(text) AS content_hash, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::INT AS tokens_count FROM documents")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.token_count(F.col("text")).alias("tokens_count"))


@R.add("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that stand in several documents."""
    return table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")


@R.add("""SELECT doc_id, unnest(range(0, greatest(0, length(text) - 150 - 1) + 1, 1050)) // 1050 AS chunk_index, substr(text, unnest(range(0, greatest(0, length(text) - 150 - 1) + 1, 1050)) + 1, 1200) AS content FROM documents WHERE length(text) > 0""")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.segments(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@R.add()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


@R.add("""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (
  SELECT doc_id, text, n, 0 AS chunk_index, 0::BIGINT AS s, CASE WHEN n <= 1000 THEN n WHEN strpos(reverse(substr(text, 801, 200)), '.') > 0 THEN 1000 - strpos(reverse(substr(text, 801, 200)), '.') + 1 ELSE 1000 END AS e FROM d
  UNION ALL
  SELECT doc_id, text, n, chunk_index + 1, greatest(e - 100, s + 1),
    CASE WHEN greatest(e - 100, s + 1) + 1000 >= n THEN n
         WHEN strpos(reverse(substr(text, greatest(e - 100, s + 1) + 801, 200)), '.') > 0 THEN greatest(e - 100, s + 1) + 1000 - strpos(reverse(substr(text, greatest(e - 100, s + 1) + 801, 200)), '.') + 1
         ELSE greatest(e - 100, s + 1) + 1000 END
  FROM c WHERE e < n
)
SELECT doc_id, chunk_index, s::INT AS start, e::INT AS "end", substr(text, s + 1, e - s) AS text FROM c""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


@R.add()
def budget_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 500 words with what they name; the next place depends on the last chunk's words, so SQL has no form for it: see the tests."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"), F.posexplode(chunking.budget_chunks(F.col("text"))).alias("chunk_index", "content"))
    return chunks.select("doc_id", "chunk_index", "content", chunking.chunk_metadata(F.col("content"), F.col("language")).alias("m")).select("doc_id", "chunk_index", "content", "m.*")


@R.add(r"""WITH s AS (SELECT doc_id, unnest(range(0, greatest(0, length(text) - 150 - 1) + 1, 1050)) AS place, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, place // 1050 AS chunk_index, substr(text, place + 1, 1200) AS content FROM s)
SELECT doc_id, chunk_index, nullif(regexp_extract(content, '(?i)(?:Article|Section|Clause)\s+(?:No\.?\s*)?(\d+)', 1), '') AS article_number, nullif(regexp_extract(content, '(?i)(?:Chapter|Part|Section)\s+([\p{L}\p{N}_]+)', 0), '') AS section_title FROM c""")
def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and sections that segments of English texts name."""
    parts = chunking.segments(table(spark, sf_dir, "documents"), "doc_id", "text")
    return parts.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), chunking.chunk_metadata(F.col("content"), F.lit("en")).alias("m")).select("doc_id", "chunk_index", "m.*")


@R.add("""WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+')) AS keyword, generate_subscripts(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+'), 1) AS i FROM conversations),
k AS (SELECT *, conv_id || '-' || turn AS key FROM w WHERE length(keyword) > 2 AND keyword NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'not')),
c AS (SELECT key, keyword, count(*) AS n_times, min(i) AS p FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_times DESC, p) AS rank FROM c)
SELECT key, keyword, n_times, rank::INT AS rank FROM r WHERE rank <= 10""")
def turn_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return text.keywords(rows, "key", "text")


@R.add("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: reverse(x)), chr(10)) AS reversed FROM documents WHERE text IS NOT NULL""")
def reversed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.reversed_lines(F.col("text")).alias("reversed"))


@R.add(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[ \t]*(?:[Pp]age[ \t]+)?\d+[ \t]*$', '', 'g'), '(?m)^[ \t]*[-_=*]{3,}[ \t]*$', '', 'g'), '[ \t]+', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY i) AS n FROM l),
c AS (SELECT doc_id, trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS cleaned FROM k WHERE n = 1 OR trim(line) = '' GROUP BY doc_id)
SELECT doc_id, cleaned FROM documents LEFT JOIN c USING (doc_id)""")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cleaned(F.col("text")).alias("cleaned"))


@R.add(r"""WITH c AS (SELECT lang, length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS w FROM documents)
SELECT CASE WHEN w > 0 AND a / w > 0.3 THEN 'ar' ELSE 'en' END AS detected, lang, count(*) AS n FROM c GROUP BY ALL""")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.language(F.col("text")).alias("detected"), "lang").agg(F.count("*").alias("n"))


# The given documents hold no presentation forms, so that the SQL needs no base letters; tests hold those.
@R.add(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '{hierarchy.CHAPTER}') THEN 'chapter' WHEN regexp_matches(line, '{hierarchy.SECTION}') THEN 'section' WHEN regexp_matches(line, '{hierarchy.ARTICLE}') THEN 'article' ELSE 'other' END AS kind FROM l),
p AS (SELECT *, max(CASE WHEN kind = 'chapter' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chapter FROM k)
SELECT doc_id, count(*) FILTER (WHERE kind = 'chapter') AS n_chapters, count(*) FILTER (WHERE kind = 'section') AS n_sections, count(*) FILTER (WHERE kind = 'article') AS n_articles, count(*) FILTER (WHERE kind = 'article' AND chapter IS NULL) AS n_orphaned,
round(coalesce(avg(CASE kind WHEN 'chapter' THEN 0.85 WHEN 'section' THEN 0.80 WHEN 'article' THEN 0.85 END), 0.0), 6) AS structure_confidence FROM p GROUP BY doc_id""")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of every document's lines."""
    return hierarchy.structure(hierarchy.placed(hierarchy.classified(hierarchy.lines(table(spark, sf_dir, "documents")))))


#: Words that begin lines of the given texts, in the place of a judgment's headings.
MARKERS = {"summary": "the|der|la", "facts": "of|und|de", "ruling": "and|ist|que"}


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*(?:the|der|la)(?:[^\p{L}\p{N}_]|$)') THEN 'summary' WHEN regexp_matches(line, '(?i)^\s*(?:of|und|de)(?:[^\p{L}\p{N}_]|$)') THEN 'facts' WHEN regexp_matches(line, '(?i)^\s*(?:and|ist|que)(?:[^\p{L}\p{N}_]|$)') THEN 'ruling' END AS mark FROM l),
s AS (SELECT *, count(mark) OVER w AS section, last_value(mark IGNORE NULLS) OVER w AS type, count(mark) OVER (PARTITION BY doc_id) AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, section, coalesce(type, 'summary') AS section_type, trim(string_agg(CASE WHEN mark IS NOT NULL THEN regexp_replace(line, '(?i)^\s*(?:the|der|la|of|und|de|and|ist|que)\s*:?', '') ELSE line END, chr(10) ORDER BY i), ' ' || chr(10) || chr(9)) AS part FROM s WHERE section > 0 OR n = 0 GROUP BY ALL)
SELECT doc_id, section_type, string_agg(part, chr(10) || chr(10) ORDER BY section) AS content FROM p GROUP BY ALL""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into sections at lines that begin with a marker, repeated markers included."""
    return hierarchy.case_sections(table(spark, sf_dir, "documents"), markers=MARKERS)


#: Frequent words of the given texts and the phrases of judgments that stand in their place.
PLANTED = {" und ": " الوقائع ", " the ": " حكمت المحكمة ", " de ": " الدفوع ", " la ": " المادة 12 ", " and ": " نبذة "}


@R.add(r"""WITH d AS (SELECT doc_id, text, replace(replace(replace(replace(replace(text, ' und ', ' الوقائع '), ' the ', ' حكمت المحكمة '), ' de ', ' الدفوع '), ' la ', ' المادة 12 '), ' and ', ' نبذة ') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, string_split(regexp_replace(t, '(الوقائع|حكمت المحكمة|الدفوع|المادة 12|نبذة)', chr(1) || '\1', 'g'), chr(1)) AS p FROM d),
m AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM c),
k AS (SELECT doc_id, i, CASE WHEN x LIKE 'الوقائع%' THEN 'facts' WHEN x LIKE 'حكمت المحكمة%' THEN 'ruling' WHEN x LIKE 'الدفوع%' THEN 'arguments' WHEN x LIKE 'المادة 12%' THEN 'legal_basis' WHEN x LIKE 'نبذة%' THEN 'summary' END AS section_type,
regexp_replace(regexp_replace(x, '^(الوقائع|حكمت المحكمة|الدفوع|المادة 12|نبذة)', ''), '^\s+|\s+$', '', 'g') AS part FROM m),
j AS (SELECT doc_id, section_type, ltrim(string_agg(part, chr(10) || chr(10) ORDER BY i), chr(10)) AS content FROM k WHERE section_type IS NOT NULL GROUP BY ALL)
SELECT doc_id, section_type, content FROM j WHERE content <> '' UNION ALL SELECT doc_id, 'summary', t FROM d WHERE doc_id NOT IN (SELECT doc_id FROM j WHERE content <> '')""")
def judgment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts in which phrases of judgments stand in the place of frequent words."""
    planted = F.col("text")
    for word, phrase in PLANTED.items():
        planted = F.replace(planted, F.lit(word), F.lit(phrase))
    return hierarchy.judgment_sections(table(spark, sf_dir, "documents").select("doc_id", planted.alias("text")))


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 50 ELSE p_size END AS score FROM part")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk scores of reports on parts, in the four ways in which they are stated or not."""
    size = F.col("p_size").cast("string")
    report = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Risk Score: "), size)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("في 30% درجة المخاطر: "), size))
    report = report.when(F.col("p_partkey") % 4 == 2, F.concat(F.col("p_name"), F.lit(" risk "), size, F.lit(" %"))).otherwise(F.concat(F.col("p_name"), F.lit(" in "), size, F.lit("% of cases")))
    return table(spark, sf_dir, "part").select("p_partkey", text.risk_score(report).alias("score"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)password["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'password="***"', 'g'), '(?i)token["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'token="***"', 'g'),
'(?i)email["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'email="***@***.***"', 'g'), '(?i)authorization["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'authorization="***"', 'g') AS masked FROM documents""")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the values of secrets hidden."""
    return table(spark, sf_dir, "documents").select("doc_id", text.masked_secrets(F.col("text")).alias("masked"))


@R.add(r"""SELECT doc_id, length(text)::INT AS n_chars, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n_paragraphs,
len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?؟]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''))::INT AS n_sentences FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, paragraphs and sentences of every document."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("n_chars"), F.size(text.paragraphs(c)).alias("n_paragraphs"), F.size(text.sentences(c)).alias("n_sentences"))


@R.add("""SELECT event_id, sha256('{"k": ' || (props->>'$.k') || '}') AS props_hash FROM events""")
def event_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of JSON whatever the order of its keys."""
    return table(spark, sf_dir, "events").select("event_id", text.json_hash(F.col("props")).alias("props_hash"))


@R.add("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns joined in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda s: s["text"]), "\n\n").alias("whole"), F.count("*").alias("n_turns"))


@R.add("""SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations, max(length(text))::INT AS longest FROM conversations GROUP BY role""")
def role_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"), F.max(F.length("text")).alias("longest"))


@R.add("""SELECT quality, toxic, count(*) AS n, count(d.doc_id) AS n_present, round(avg(length(text)), 6) AS mean_chars FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY ALL""")
def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_text"), F.lit(1).alias("present"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count("present").alias("n_present"), F.round(F.avg("n_text"), 6).alias("mean_chars"))


@R.add()
def separated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents at paragraphs, lines or words; a recursion over separators is no SQL, so tests hold the function against its rule as told."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.separated_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return chunks.select("doc_id", "chunk_index", "chunk")
