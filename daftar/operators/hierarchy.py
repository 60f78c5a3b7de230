"""Document structure from lines: classification, running chapter, section and article, sections of judgments, contents pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daftar.functions.arabic import base_letters, ordinal_number
from daftar.functions.display import evaluated_once

#: How headings begin, by kind, from the outermost, and the marks of sub-articles.
CHAPTER = r"^\s*(?:الباب|(?i:part|title))\s+\S"
SECTION = r"^\s*(?:الفصل|(?i:chapter|section))\s+\S|^\s*(?:أولاً|ثانياً|ثالثاً|رابعاً|خامساً|سادساً|سابعاً|ثامناً|تاسعاً|عاشراً)"
ARTICLE = r"^\s*(?:(?:ال)?مادة\s*[:：]?\s*\S|م\s*[.．]\s*[0-9٠-٩]|(?i:article)\s+\S)"
SUB_ARTICLE = r"^\s*(?:[0-9٠-٩]+|[أ-ي])\s*[-–—).]\s*"
CONTENTS = r"(?i)فهرس|المحتويات|محتوى الكتاب|index|contents"
CASE_MARKERS = {"summary": "ملخص|summary", "facts": "الوقائع|facts", "arguments": "الحجج|الدفوع|arguments", "ruling": "الحكم|منطوق|ruling", "legal_basis": "الأساس القانوني|الأسانيد|legal basis"}


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_number (from 1), line."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("line_number"), "line")


def _kind(plain: Column) -> Column:
    return F.when(F.trim(plain) == "", "blank").when(plain.rlike(CHAPTER), "chapter").when(plain.rlike(SECTION), "section").when(plain.rlike(ARTICLE), "article").when(plain.rlike(SUB_ARTICLE), "sub_article").otherwise("content")


def kind(line: Column) -> Column:
    """chapter, section, article, sub_article, content or blank; the outermost kind wins."""
    return _kind(base_letters(line))


#: The headings that are surest, as PDFs give them, in presentation forms; and what confidence each kind has, with and without them.
SUREST = {"chapter": ("ﺍﻟﺒﺎﺏ ﺍﻟﺤﺎﺩﻱ ﻋﺸﺮ", "ﺍﻟﺒﺎﺏ ﺍﻟﺜﺎﻧﻲ ﻋﺸﺮ"), "section": ("ﺍﻟﻔﺼﻞ ﺍﻷﻭﻝ", "ﺍﻟﻔﺼﻞ ﺍﻟﺜﺎﻧﻲ", "ﺍﻟﻔﺼﻞ ﺍﻟﺜﺎﻟﺚ"), "article": ("ﺍﻟﻤﺎﺩﺓ ﺍﻟﺤﺎﺩﻳﺔ ﻭﺍﻟﻌﺸﺮﻭﻥ", "ﺍﻟﻤﺎﺩﺓ ﺍﻟﺜﺎﻧﻴﺔ ﻭﺍﻟﻌﺸﺮﻭﻥ")}
CONFIDENCE = {"chapter": (0.95, 0.85), "section": (0.90, 0.80), "article": (0.95, 0.85), "sub_article": (0.80, 0.80), "content": (0.70, 0.70), "blank": (1.0, 1.0)}


def confidence(kind_: Column, line: Column) -> Column:
    """How sure a line's kind is."""
    out = F.lit(None).cast("double")
    for name, (most, least) in CONFIDENCE.items():
        surest = reduce(lambda a, b: a | b, (line.contains(x) for x in SUREST.get(name, ())), F.lit(False))
        out = F.when(kind_ == name, F.when(surest, most).otherwise(least)).otherwise(out)
    return out


def classified(rows: DataFrame) -> DataFrame:
    """Lines with kind, number (of headings) and confidence."""
    plain = rows.withColumn("_plain", base_letters(F.col("line")))
    k = plain.withColumn("kind", _kind(F.col("_plain")))
    k = k.withColumn("number", F.when(F.col("kind").isin("chapter", "section", "article"), ordinal_number(F.col("_plain"))))
    return k.withColumn("confidence", confidence(F.col("kind"), F.col("line"))).drop("_plain")


def placed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Classified lines with chapter_id, section_id and article_id. A chapter begins without section and article, a section without article; a section counts only inside a chapter."""
    order = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.when(F.col("kind") == k, F.col("line_number"))
    rows = rows.withColumns({"chapter_id": F.last(is_("chapter"), ignorenulls=True).over(order), "_section": F.last(is_("section"), ignorenulls=True).over(order), "_article": F.last(is_("article"), ignorenulls=True).over(order)})
    rows = rows.withColumn("section_id", F.when(F.col("_section") > F.col("chapter_id"), F.col("_section")))
    start = F.greatest(F.coalesce("section_id", F.lit(0)), F.coalesce("chapter_id", F.lit(0)))
    return rows.withColumn("article_id", F.when(F.col("_article") > start, F.col("_article"))).drop("_section", "_article")


def structure(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document how many chapters, sections, articles and orphaned articles (outside chapters), and the mean confidence of headings, 0.0 without any."""
    heading = F.col("kind").isin("chapter", "section", "article")
    return rows.groupBy(key).agg(
        F.count_if(F.col("kind") == "chapter").alias("n_chapters"), F.count_if(F.col("kind") == "section").alias("n_sections"), F.count_if(F.col("kind") == "article").alias("n_articles"),
        F.count_if((F.col("kind") == "article") & F.col("chapter_id").isNull()).alias("n_orphaned"), F.round(F.coalesce(F.avg(F.when(heading, F.col("confidence"))), F.lit(0.0)), 6).alias("structure_confidence"),
    )


def article_texts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Placed lines of each article joined in order, its heading first. Content before any article is dropped."""
    held = rows.where("article_id is not null").groupBy(key, "chapter_id", "section_id", "article_id")
    return held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda s: s["line"]), "\n").alias("content"))


def numbering_issues(rows: DataFrame, key: str = "doc_id", number: str = "number") -> DataFrame:
    """rows: articles, or classified lines, of which articles count. Per document those whose stated number, without `/` and `-`, is no run of digits, and its validity 1 - 0.1 per issue, at least 0."""
    rows = rows.where("kind = 'article'") if "kind" in rows.columns else rows
    bad = ~F.coalesce(F.regexp_replace(F.col(number).cast("string"), "[/-]", "").rlike(r"^[\p{Nd}]+$"), F.lit(False))
    return rows.groupBy(key).agg(F.count_if(bad).alias("n_issues")).withColumn("validity", F.greatest(F.lit(0.0), 1.0 - 0.1 * F.col("n_issues")))


#: What a contents page, its entries and its end look like.
ENTRY_PAGE = r"\.+\s*\d+\s*$|\s+\d+\s*$"
ENTRY_WORDS = "الباب|الفصل|المادة|أولاً|ثانياً"
FIRST_ARTICLE = r"المادة الأولى|المادة\s+الاولى|المادة\s+1\s*:|المادة\s+١|مادة\s+1\s*:|الفصل الأول|الباب الأول|بداية النص|(?i:start of text|beginning of document)"
AHEAD = 15
PREFIXED, PREFIXED_HEADING = r"^\s*[Cc]hapter\s+", r"^\s*[Cc]hapter\s+(?:الباب|الفصل)"


def contents_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with in_contents. Where three lines or more are headings with the word Chapter before them, what lies from the first to the last is the contents page. Else it begins at a line that
    names it, or has Chapter before it and three such within 15 lines, or is an entry with a page number and three such within 5, or names a part and 5 do within 10 with less than two long lines between; it ends before
    the first article, or first heading, that has no page number, a part that is followed by text within 5 lines, or a page number alone before a chapter within 3; else with the document."""
    w = Window.partitionBy(key).orderBy("line_number")
    marks = contents_marks(rows, w)
    whole = Window.partitionBy(key)
    prefixed = F.when(F.col("_prefixed"), F.col("line_number"))
    marks = marks.withColumns({"_n": F.count(prefixed).over(whole), "_from": F.min(prefixed).over(whole), "_to": F.max(prefixed).over(whole)})
    # A line is inside from a beginning on, until an end: the last of either before it decides, and an end counts only inside.
    last = F.last(F.when(F.col("_ends"), F.struct(F.lit(False).alias("b"))).when(F.col("_begins"), F.struct(F.lit(True).alias("b"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["b"]
    inside = F.when(F.col("_n") >= 3, F.col("line_number").between(F.col("_from"), F.col("_to"))).otherwise(F.coalesce(last, F.lit(False)))
    return marks.withColumn("in_contents", inside).drop("_n", "_from", "_to", "_prefixed", "_begins", "_ends")


def contents_marks(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """Lines with _prefixed (a heading with the word Chapter before it), _begins and _ends (where a contents page does), which look at most AHEAD lines ahead in the window's order."""
    ahead = lambda c, n: F.count_if(c).over(w.rowsBetween(0, n - 1))
    after = lambda c, n: F.count_if(c).over(w.rowsBetween(1, n)) > 0
    own = rows.withColumn("_line", F.trim(base_letters(F.col("line"))))
    line = F.col("_line")
    page, part, heading = line.rlike(ENTRY_PAGE), line.rlike("الباب"), line.rlike("الباب|الفصل")
    return own.withColumns({
        "_prefixed": line.rlike(PREFIXED_HEADING),
        "_begins": line.rlike(CONTENTS) | line.rlike(PREFIXED) & (ahead(line.rlike(PREFIXED), AHEAD) >= 3) | page & line.rlike(ENTRY_WORDS) & (ahead(page & line.rlike(ENTRY_WORDS), 5) >= 3) | part & (ahead(part, 10) >= 5) & (ahead(~part & (F.length(line) > 100), 10) < 2),
        "_ends": line.rlike(FIRST_ARTICLE) & ~page | heading & after((F.length(line) > 50) & ~line.rlike("الباب|الفصل|Chapter"), 4) | line.rlike(r"^\d+$") & after(_kind(line) == "chapter", 3),
    }).drop("_line")


def case_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", markers: dict[str, str] = CASE_MARKERS) -> DataFrame:
    """Sections of judgments: key, section_type, content. A line that begins with a marker begins its section, with what follows the marker; sections of one type are joined by blank lines. What stands before the first marker is in none; texts without a marker are a summary."""
    mark = reduce(lambda rest, kv: F.when(F.col("line").rlike(f"(?i)^\\s*(?:{kv[1]})(?![\\p{{L}}\\p{{N}}_])"), kv[0]).otherwise(rest), reversed(markers.items()), F.lit(None).cast("string"))
    any_mark = "(?i)^\\s*(?:" + "|".join(markers.values()) + ")(?![\\p{L}\\p{N}_])\\s*:?"
    w = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    own = lines(documents, key, text).withColumn("_mark", mark)
    own = own.withColumns({"_section": F.count("_mark").over(w), "_type": F.last("_mark", ignorenulls=True).over(w), "_any": F.count("_mark").over(Window.partitionBy(key))})
    own = own.where((F.col("_section") > 0) | (F.col("_any") == 0)).withColumn("line", F.when(F.col("_mark").isNotNull(), F.regexp_replace("line", any_mark, "")).otherwise(F.col("line")))
    joined = lambda parts, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda s: s[parts[1]]), glue)
    each = own.groupBy(key, "_section", F.coalesce("_type", F.lit("summary")).alias("section_type")).agg(F.btrim(joined(("line_number", "line"), "\n"), F.lit(" \n\t")).alias("part"))
    return each.groupBy(key, "section_type").agg(joined(("_section", "part"), "\n\n").alias("content"))


#: The phrases that begin the sections of judgments, anywhere in a text, by section, from the most particular.
JUDGMENT_PHRASES = {
    "summary": (r"الحمدلله\s+والصلاة\s+والسلام\s+على\s+رسول\s+الله", r"الحمد\s+لله\s+والصلاة\s+والسلام", r"أما\s+بعد", r"ملخص\s+القضية", r"ملخص\s+الدعوى", "ملخص", "نبذة", "موجز", "الملخص"),
    "facts": (r"تتحصل\s+وقائع", r"ما\s+ورد\s+في\s+صحيفة\s+الدعوى", r"ما\s+جاء\s+في\s+الدعوى", r"وقائع\s+القضية", r"وقائع\s+الدعوى", "الوقائع", "الواقعة", "الحادثة"),
    "arguments": (r"تقرير\s+المحامي", r"طلب\s+إلزام", r"حجج\s+الأطراف", r"أقوال\s+الأطراف", "المرافعات", "الدفوع", "الأسباب", "الحجج", "دفاع", "الحجة"),
    "ruling": (r"نص\s+الحكم", r"منطوق\s+الحكم", r"حكمت\s+المحكمة", r"قررت\s+المحكمة", r"حكم\s+نهائي", "المنطوق", "الحكم", "القرار"),
    "legal_basis": (
        r"نظام\s+المحاكم\s+التجارية", r"لائحة\s+الدعوى", r"أوراق\s+ومستندات", r"المادة\s+الثلاثون", r"المادة\s+الثلاثين", r"المادة\s+التاسعة\s+والعشرون", r"المادة\s+التاسعة\s+والعشرين",
        r"المادة\s+\d+", r"الأساس\s+القانوني", r"السند\s+القانوني", r"التكييف\s+القانوني", r"الأسانيد\s+القانونية", r"المستند\s+القانوني", "الحيثيات",
    ),
}


#: White space and digits of all scripts inside patterns.
_WHITE, _DIGIT = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"\p{Nd}"


def _letters(phrase: str) -> str:
    """The letters that every text which matches a phrase begins with: those of a phrase of words, white space and numbers alone."""
    return re.match(r"[^\W\d_]+", phrase)[0] if re.fullmatch(r"[^\W\d_]+(?:[^\W\d_ ]| |\\s\+|\\d\+)*", phrase) else ""


def judgment_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, tuple[str, ...]] = JUDGMENT_PHRASES) -> DataFrame:
    """Sections of judgments by phrases anywhere in the text: key, section_type, content; sections without content are left out.

    A section reaches from the end of a phrase to where the next begins; where a phrase reaches into the next one, or another phrase begins at the same place, its part is empty. The parts of a type are joined
    by blank lines, empty ones after the first with content too. What stands before the first phrase is in no section. A text without any content in sections is a summary as a whole; null has none.

    One expression a row: the text is cut where phrases begin, and what the cuts hold is joined by section.
    """
    wide = {p: p.replace(r"\s", _WHITE).replace(r"\d", _DIGIT) for ps in phrases.values() for p in ps}
    begins = {p[0] for ps in phrases.values() for p in ps}
    quick = f"(?=[{min(begins)}-{max(begins)}])(?=[{''.join(sorted(begins))}])" if all(map(str.isalpha, begins)) else ""  # most places fail here
    anywhere = f"{quick}(?=" + "|".join(wide.values()) + ")"
    trim = lambda c: F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")
    parts = F.split(F.col(text), anywhere)

    def markers(cuts: Column) -> Column:
        """For each cut the phrases that begin it, in their order, as type and content: of all but the last the content is empty."""

        def of_cut(cut: Column, i: Column) -> Column:
            def contents(found: Column) -> Column:
                rest = lambda m: trim(F.substring(cut, m["n"] + 1, F.length(cut)))
                return F.transform(found, lambda m, j: F.struct(m["type"].alias("type"), F.when((j == F.size(found) - 1) & (m["n"] <= F.length(cut)), rest(m)).otherwise("").alias("content")))

            def begun(ahead: Column) -> Column:
                # A pattern that may also match nothing is done at the first character; another would be tried at all of them.
                length = lambda p: F.length(F.regexp_extract(ahead, f"^({p})?", 1))
                one = lambda t, p: F.when(length(wide[p]) > 0, F.struct(F.lit(t).alias("type"), length(wide[p]).alias("n")))
                each = (F.when(F.startswith(ahead, F.lit(start)), one(t, p)) if (start := _letters(p)) else one(t, p) for t, ps in phrases.items() for p in ps)
                return evaluated_once(F.array_compact(F.array(*each)), contents)

            return evaluated_once(F.concat_ws("", F.slice(cuts, i + 1, 4)), begun)  # a phrase may reach over the cuts of others

        return F.flatten(F.transform(cuts, of_cut))

    def joined(marked: Column) -> Column:
        """The sections with content; the contents of a type are trimmed, so that line feeds before them are of empty ones."""
        of = lambda t: F.array_join(F.transform(F.filter(marked, lambda m: m["type"] == t), lambda m: m["content"]), "\n\n")
        each = F.array(*(F.struct(F.lit(t).alias("section_type"), F.ltrim(of(t), F.lit("\n")).alias("content")) for t in phrases))
        return F.filter(each, lambda s: s["content"] != "")

    whole = F.array(F.struct(F.lit("summary").alias("section_type"), F.col(text).alias("content")))
    filled = evaluated_once(evaluated_once(parts, markers), joined)
    sections = evaluated_once(filled, lambda held: F.when(F.size(held) > 0, held).otherwise(whole))
    return documents.where(F.col(text).isNotNull()).select(key, F.explode(sections).alias("s")).select(key, "s.section_type", "s.content")
