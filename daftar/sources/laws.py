"""Readers: law and case JSON in all layouts, plain text in several encodings, DOCX; and the JSON rewrite of hierarchical laws."""

from __future__ import annotations

import io

import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar import schemas
from daftar.functions.text import first_number, gregorian_or_hijri_digits, json_hash, parsed_date, token_count

#: Encodings in the order they are tried; the last never fails.
ENCODINGS = ("utf-8", "windows-1256", "iso-8859-6", "utf-16", "iso-8859-1")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _laws(text: Column) -> Column:
    """The laws in any layout: a bare list, a list or one object under law_sources, one under law_source, a bare object."""
    many, one = f"array<{schemas.LAW_JSON}>", schemas.LAW_JSON
    key = lambda name: F.get_json_object(text, f"$.{name}")
    as_list = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, many)).when(F.ltrim(c).startswith("{"), F.array(F.from_json(c, one)))
    bare = F.when(F.get_json_object(text, "$.name").isNotNull(), F.array(F.from_json(text, one)))
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, many)), as_list(key("law_sources")), as_list(key("law_source")), bare)


def laws(files: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per law with a name: law_id (the hash of the file's JSON, whatever its name and the order of its keys, and the law's place), the law's columns and its raw articles and branches. Corrupt files give none. first_only: only each file's first law."""
    rows = files.select(json_hash(F.col("text")).alias("_hash"), F.posexplode(_laws(F.col("text"))).alias("_i", "law")).where("law.name is not null")
    rows = rows.where("_i = 0") if first_only else rows
    return rows.select(F.concat_ws("_", "_hash", "_i").alias("law_id"), "law.*").withColumnRenamed("issue_date", "issue_date_raw").withColumn("issue_date", parsed_date(F.col("issue_date_raw"))).withColumn("issue_date_clean", gregorian_or_hijri_digits(F.col("issue_date_raw")))


def articles(law_rows: DataFrame) -> DataFrame:
    """Articles of both layouts: law_id, branch_name, chapter_name, article_number, title, content, keywords, order_index (stated, else the number's digits, else the place)."""
    flat = law_rows.select("law_id", F.lit(None).cast("string").alias("branch_name"), F.lit(None).cast("string").alias("chapter_name"), F.posexplode("articles").alias("_i", "a"))
    chapters = law_rows.select("law_id", F.posexplode("branches").alias("_b", "b")).select("law_id", "_b", F.col("b.branch_name").alias("branch_name"), F.posexplode("b.chapters").alias("_c", "c"))
    nested = chapters.select("law_id", "branch_name", F.col("c.chapter_name").alias("chapter_name"), F.posexplode("c.articles").alias("_p", "a"), "_b", "_c").withColumn("_i", F.col("_b") * 1_000_000 + F.col("_c") * 10_000 + F.col("_p"))
    every = flat.unionByName(nested.select("law_id", "branch_name", "chapter_name", "_i", "a"))
    number, content = F.coalesce("a.article", "a.article_number"), F.coalesce("a.text", "a.content")
    return every.where(content.isNotNull() & (F.trim(content) != "")).select(
        "law_id", "branch_name", "chapter_name", number.alias("article_number"), F.col("a.title").alias("title"), content.alias("content"), F.col("a.keywords").alias("keywords"),
        F.coalesce("a.order_index", first_number(number), F.col("_i") + 1).alias("order_index"),
    )


def cases(files: DataFrame) -> DataFrame:
    """Sections of cases: case_id (the hash of the file's JSON and the case's place), the case's columns, section_index, section_type (unknown ones are summary), content, tokens_count. Cases without sections keep a row."""
    listed = F.from_json(F.get_json_object("text", "$.legal_cases"), f"array<{schemas.CASE_JSON}>")
    rows = files.select(json_hash(F.col("text")).alias("_hash"), F.posexplode(listed).alias("_i", "c")).select(F.concat_ws("_", "_hash", "_i").alias("case_id"), "c.*")
    each = rows.select("case_id", "case_number", "title", "jurisdiction", "court_name", parsed_date(F.col("decision_date")).alias("decision_date"), "case_type", "court_level", F.posexplode_outer("sections").alias("section_index", "s"))
    kind = F.when(F.col("s.section_type").isin(*schemas.SECTION_TYPES), F.col("s.section_type")).otherwise("summary")
    return each.withColumn("section_type", F.when(F.col("s").isNotNull(), kind)).withColumn("content", F.col("s.content")).withColumn("tokens_count", token_count(F.col("content"))).drop("s")


def decoded(content: Column) -> Column:
    """Bytes as text by the first of ENCODINGS that fits."""

    @F.pandas_udf("string")
    def decode(blobs: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            marked = b is not None and bytes(b[:2]) in (b"\xff\xfe", b"\xfe\xff")  # a byte order mark says utf-16
            for e in () if b is None else ("utf-16", *ENCODINGS) if marked else ENCODINGS:
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    continue
            return None

        return blobs.map(one)

    return decode(content)


def docx_text(content: Column) -> Column:
    """Paragraphs of DOCX bytes, one per line; null for what is no DOCX."""

    @F.pandas_udf("string")
    def read(blobs: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(b))).read("word/document.xml"))
            except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                return None
            ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            return "\n".join(t for p in root.iter(f"{ns}p") if (t := "".join(x.text or "" for x in p.iter(f"{ns}t"))).strip())

        return blobs.map(one)

    return read(content)


def documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Files of a folder: path, kind (json, txt, docx, other), text; text is null for kinds without a reader, or, if strict, such a file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("json", "txt", "docx"), ext).otherwise("other")
    if strict:
        kind = F.when(kind == "other", F.raise_error(F.concat(F.lit("no reader for "), F.col("path")))).otherwise(kind)
    return files.select("path", kind.alias("kind"), "content").withColumn("text", F.when(F.col("kind").isin("json", "txt"), decoded(F.col("content"))).when(F.col("kind") == "docx", docx_text(F.col("content")))).withColumn("file_hash", F.sha2("content", 256)).drop("content")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known and that no other file of the same content precedes."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("path"))
    return files.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash"), "file_hash", "left_anti")


def flattened_laws(law_rows: DataFrame) -> DataFrame:
    """Laws of the hierarchical layout rewritten to the flat one: law_id, json."""
    held = articles(law_rows).groupBy("law_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "article_number", "title", "content"))).alias("articles"))
    return law_rows.join(held.withColumnRenamed("articles", "_articles"), "law_id", "left").select("law_id", F.to_json(F.struct("name", "type", "jurisdiction", F.coalesce("_articles", F.array().cast(held.schema["articles"].dataType)).alias("articles"))).alias("json"))


def metadata_text(values: Column) -> Column:
    """A list as one scalar, joined by comma and space."""
    return F.array_join(values, ", ")
