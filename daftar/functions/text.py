"""Text columns: hashes, dates, counts, keywords, cleaning, masking and validation, all as built-in expressions."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Date patterns in the order they are tried, and words that are no keywords.
DATE_PATTERNS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not")
BROWSERS = ("Chrome", "Firefox", "Safari", "Edge")
ARABIC = r"[\x{0600}-\x{06FF}]"


def content_hash(c: Column) -> Column:
    """SHA-256 of the text's bytes, in hex."""
    return F.sha2(c, 256)


def parsed_date(c: Column) -> Column:
    """The first pattern that fits; null for all else, such as dates of another calendar."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(p))) for p in DATE_PATTERNS))


def gregorian_or_hijri_digits(c: Column) -> Column:
    """A date with its calendar suffix removed, `/` as `-`, and month and day of two digits."""
    parts = F.split(F.regexp_replace(F.trim(F.regexp_replace(c, "[همـ]+\\s*$", "")), "/", "-"), "-")
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).otherwise(F.array_join(parts, "-"))


def words(c: Column) -> Column:
    """Parts between white space; none for null and blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


def first_number(c: Column) -> Column:
    """The first run of digits, Arabic-Indic and Persian ones too, as long."""
    return F.nullif(F.translate(F.regexp_extract(c, r"[0-9٠-٩۰-۹]+", 0), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2), F.lit("")).try_cast("long")


def article_chunk(title: Column, content: Column, number: Column) -> Column:
    """Chunk text of an article: a header of number and title where there are any, then the content."""
    label = F.when(F.trim(number) != "", F.concat(F.lit("المادة "), F.trim(number)))
    header = F.concat_ws(" - ", label, F.when(F.trim(title) != "", F.trim(title)))
    return F.when(header == "", content).otherwise(F.concat_ws("\n", header, content))


#: What sections of a judgment are called in chunks.
SECTION_LABELS = {"summary": "ملخص القضية", "facts": "الوقائع", "arguments": "الحجج", "ruling": "الحكم", "legal_basis": "الأساس القانوني"}


def case_chunk(section_type: Column, content: Column) -> Column:
    label = F.create_map(*(F.lit(x) for kv in SECTION_LABELS.items() for x in kv))
    return F.concat_ws("\n", F.coalesce(F.try_element_at(label, section_type), section_type), content)


#: A letter, digit or underscore.
WORD = r"[\p{L}\p{N}_]"


def arabic_share(c: Column) -> Column:
    """Arabic characters over word characters; 0 without any. Texts without Arabic are not counted through."""
    n = F.regexp_count(c, F.lit(WORD))
    return F.when(c.rlike(ARABIC) & (n > 0), F.regexp_count(c, F.lit(ARABIC)) / n).otherwise(0.0)


def language(c: Column) -> Column:
    return F.when(F.coalesce(arabic_share(c), F.lit(0.0)) > 0.3, "ar").otherwise("en")


def text_statistics(c: Column) -> Column:
    """n_chars, n_arabic, arabic_ratio (of all characters, 4 digits)."""
    n, arabic = F.length(c), F.regexp_count(c, F.lit(ARABIC))
    return F.struct(n.alias("n_chars"), arabic.alias("n_arabic"), F.when(n > 0, F.round(arabic / n, 4)).otherwise(0.0).alias("arabic_ratio"))


def repaired_share(before: Column, after: Column) -> Column:
    """Statistics of a text before and after its repair, and by how much the Arabic ratio grew (4 digits)."""
    a, b = text_statistics(before), text_statistics(after)
    return F.struct(a.alias("before"), b.alias("after"), F.round(b["arabic_ratio"] - a["arabic_ratio"], 4).alias("delta"))


def keyword_words(c: Column) -> Column:
    """Lower-cased words without marks, longer than two and no stop words, in text order."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def keywords(rows: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """The n most frequent keywords of each text: key, keyword, n_times, rank; ties by first place."""
    each = rows.select(key, F.posexplode(keyword_words(F.col(text))).alias("pos", "keyword"))
    counts = each.groupBy(key, "keyword").agg(F.count("*").alias("n_times"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(key).orderBy(F.desc("n_times"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, "keyword", "n_times", "rank")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Parts that end in a full stop, an exclamation or question mark, Arabic ones too."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?؟]+"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")


def unique_lines(c: Column) -> Column:
    """Lines without those that, trimmed, stand before; empty lines stay. Lines are sorted once by content and place, so that repeated ones follow each other."""
    placed = F.sort_array(F.transform(F.split(c, "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i"), x.alias("line"))))
    none = F.filter(F.transform(placed, lambda x: F.lit(None).cast("struct<t:string,i:int,line:string>")), lambda x: F.lit(True))
    before = F.concat(F.slice(none, 1, 1), placed)
    first = F.filter(F.zip_with(placed, before, lambda a, b: F.when(a.isNotNull() & ((a["t"] == "") | b.isNull() | (a["t"] != b["t"])), F.struct(a["i"].alias("i"), a["line"].alias("line")))), lambda x: x.isNotNull())
    return F.array_join(F.transform(F.sort_array(first), lambda x: x["line"]), "\n")


def cleaned(c: Column) -> Column:
    """Newlines unified, lines of page numbers and rules dropped, runs of spaces and of blank lines cut, repeated lines dropped, trimmed."""
    steps = ((r"\r\n?", "\n"), (r"(?md)^[ \t]*(?:[Pp]age[ \t]+)?\d+[ \t]*$", ""), (r"(?md)^[ \t]*[-_=*]{3,}[ \t]*$", ""), (r"[ \t]+", " "))
    lines = unique_lines(reduce(lambda x, s: F.regexp_replace(x, F.lit(s[0]), F.lit(s[1])), steps, c))
    return F.btrim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def reversed_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.reverse(x)), "\n")


def right_to_left_marked(c: Column) -> Column:
    """Lines with Arabic letters between right-to-left marks."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(ARABIC), F.concat(F.lit("‫"), x, F.lit("‬"))).otherwise(x)), "\n")


def filled(template: Column, values: Column) -> Column:
    """A template with {{key}}, then {key}, replaced by the values of a map."""
    double = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.aggregate(F.map_entries(values), double, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


#: Where a risk score stands, in the order in which they are tried.
RISK = (r"درجة\s*المخاطر[:\-]?\s*(\d+)", r"Risk\s*Score[:\-]?\s*(\d+)", r"المخاطر[:\-]?\s*(\d+)\s*%", r"Risk[:\-]?\s*(\d+)\s*%")


def risk_score(c: Column) -> Column:
    """The number of the first of the four patterns that a text holds, in any digits; 50 without any. Null for null."""
    digits = lambda x: F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    found = (F.nullif(digits(F.regexp_extract(c, f"(?iuU){p}", 1)), F.lit("")).try_cast("int") for p in RISK)
    return F.when(c.isNotNull(), F.coalesce(*found, F.lit(50)))


def risk_label(score: Column) -> Column:
    return F.when(score < 25, "low").when(score < 50, "medium").when(score < 75, "high").otherwise("critical")


def bullets(c: Column, n: int = 10) -> Column:
    """The first n bullet items."""
    return F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*[-*•][ \t]+(.+)$"), F.lit(1)), lambda x: F.trim(x)), 1, n)


def json_in(c: Column) -> Column:
    """JSON text inside other text: all of it, a fenced block, or from the first brace to the last; null if none parses."""
    tries = (F.trim(c), F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in tries))


def listed_items(c: Column, key: str, n: int = 10) -> Column:
    """For text without JSON: after the first line that names the key (`weak_points` or `weak point`), the first n items: lines with a bullet or one of the numbers 1 to 3, and other lines of more than 10 characters but brackets."""
    named = F.array(F.lit(key), F.lit(key.rstrip("s").replace("_", " ")))
    lines = F.split(c, "\n")
    hits = F.transform(lines, lambda x: F.exists(named, lambda k: F.contains(F.lower(x), k)))
    start = F.array_position(hits, True)
    item = lambda x: F.when(x.rlike(r"^\s*(?:[-•*]|[123]\.)"), F.nullif(F.trim(F.regexp_replace(x, r"^[-•*0-9.\s]+", "")), F.lit(""))).when(~x.rlike(r"^\s*[{}\[\]]") & (F.length(F.trim(x)) > 10), F.trim(x))
    rest = F.filter(F.zip_with(lines, hits, lambda x, hit: F.when(~hit, item(x))), lambda x, i: (i >= start) & x.isNotNull())
    return F.when(start > 0, F.slice(rest, 1, n)).otherwise(F.array().cast("array<string>"))


def json_hash(c: Column) -> Column:
    """SHA-256 of JSON with its keys in order, as Python's json module writes it; null for what is no JSON."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
            except ValueError:
                return None

        return texts.map(one)

    return digest(c)


def browser(user_agent: Column) -> Column:
    """The first name of BROWSERS in the header."""
    return reduce(lambda rest, b: F.when(user_agent.contains(b), b).otherwise(rest), reversed(BROWSERS), F.lit("Unknown"))


def masked_email(c: Column) -> Column:
    """The local part's first letter and the domain."""
    return F.regexp_replace(c, r"^(.)[^@]*@", "$1***@")


#: Keys whose values logs hide, and what stands there instead.
SECRETS = {"password": "***", "token": "***", "email": "***@***.***", "authorization": "***"}


def masked_secrets(c: Column) -> Column:
    """Values after `key=` or `key:`, quoted or not, hidden."""
    return reduce(lambda x, kv: F.regexp_replace(x, f"(?i){kv[0]}[\"']?\\s*[:=]\\s*[\"']?[^\"'\\s,}}]+", f'{kv[0]}="{kv[1]}"'), SECRETS.items(), c)


def valid_name(c: Column) -> Column:
    """Latin or Arabic letters, white space, hyphens and apostrophes; null and empty names are allowed."""
    return (F.coalesce(c, F.lit("")) == "") | F.coalesce(F.trim(c).rlike(r"^[a-zA-Z\x{0600}-\x{06FF}\s\-']+$"), F.lit(False))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def valid_password(c: Column) -> Column:
    """At least 8 characters with a small and a capital letter, a digit and a mark."""
    return F.coalesce((F.length(c) >= 8) & c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike(r"\d") & c.rlike(r"[^A-Za-z0-9\s]"), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s()-]", "").rlike(r"^\+?\d{9,15}$"), F.lit(False))


def days_remaining(end: Column, as_of: Column) -> Column:
    """Whole days, rounded down; 999999 without an end; 0 when past."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(as_of.cast("timestamp"))
    return F.when(end.isNull(), 999999).otherwise(F.greatest(F.lit(0), F.floor(seconds / 86400)))


def subscription_state(start: Column, end: Column, as_of: Column) -> Column:
    """active from the start to the end, without an end for ever; expired after it; pending before."""
    return F.when(start > as_of, "pending").when(end.isNull() | (end > as_of), "active").otherwise("expired")


#: Which column of a plan limits which feature.
FEATURE_LIMITS = {"file_upload": "file_limit", "ai_chat": "ai_message_limit", "contract": "contract_limit", "report": "report_limit", "token": "token_limit", "multi_user": "multi_user_limit"}


def plan_limit(feature: Column, limits: dict[str, str] = FEATURE_LIMITS) -> Column:
    """The limit of a feature in a row of plans; 0, which is none, where it is null or the feature unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*(x for name, column in limits.items() for x in (F.lit(name), F.col(column)))), feature), F.lit(0))


def reset_due(cycle: Column, last_reset: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(last_reset.cast("timestamp"))) / 86400)
    return F.coalesce(days >= F.when(cycle == "daily", 1).when(cycle == "monthly", 30).when(cycle == "yearly", 365), F.lit(False))


def truncated(c: Column, max_tokens: int, chars_per_token: float = 2.5) -> Column:
    """About max_tokens of text, cut back to a space late in the text, else to a full stop."""
    n = int(max_tokens * chars_per_token)
    head = F.substring(c, 1, n)
    space = F.lit(n) - F.instr(F.reverse(head), " ")
    stop = F.lit(n) - F.instr(F.reverse(head), ".")
    cut = F.when((F.instr(head, " ") > 0) & (space > 0.8 * n), head.substr(F.lit(1), space)).when((F.instr(head, ".") > 0) & (stop > 0.7 * n), head.substr(F.lit(1), stop + 1)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(cut)
