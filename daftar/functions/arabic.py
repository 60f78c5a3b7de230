"""Arabic text: presentation forms, fragmented letters, ordinal words, numbers of headings."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.text import ARABIC, words

# The words of the ordinals from one to ten, of masculine and feminine nouns, and the tens.
UNITS_M = ("أول", "ثاني", "ثالث", "رابع", "خامس", "سادس", "سابع", "ثامن", "تاسع", "عاشر")
UNITS_F = ("أولى", "ثانية", "ثالثة", "رابعة", "خامسة", "سادسة", "سابعة", "ثامنة", "تاسعة", "عاشرة")
ELEVENTH_M, ELEVENTH_F = "حادي", "حادية"
TEN_M, TEN_F = "عشر", "عشرة"
TENS = ("عشرون", "ثلاثون", "أربعون", "خمسون", "ستون", "سبعون", "ثمانون", "تسعون")


def presentation_forms() -> dict[str, str]:
    """Every presentation form and the letters that it stands for, by Unicode's compatibility decomposition."""
    forms = (chr(c) for r in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFC)) for c in range(r[0], r[1] + 1))
    return {c: base for c in forms if (base := unicodedata.normalize("NFKC", c)) != c and not base.startswith(" ")}


def base_letters(c: Column) -> Column:
    """Presentation forms as base letters; single letters in one pass, then the ligatures of lam and alef; ornamental ligatures of whole words stay."""
    forms = presentation_forms()
    single = {k: v for k, v in forms.items() if len(v) == 1}
    ligatures = {k: v for k, v in forms.items() if "\ufef5" <= k <= "\ufefc"}
    one = F.translate(c, "".join(single), "".join(single.values()))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ligatures.items(), one)


def without_fragments(c: Column) -> Column:
    """Runs of three or more single Arabic letters between spaces, put together."""
    letter, alone = "[ء-ي]", "(?<![^\\s])"
    runs = f"{alone}(?:{letter} ){{2,}}{letter}(?![^\\s])"
    parts, between = F.regexp_extract_all(c, F.lit(runs), F.lit(0)), F.split(c, runs)
    return F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.replace(F.get(parts, i), F.lit(" "), F.lit("")), F.lit(""))))), "")


def needs_repair(c: Column) -> Column:
    """Whether Arabic text is fragmented, has presentation forms, or makes up more than a tenth."""
    ws = words(c)
    letters = F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))
    arabic = F.regexp_count(c, F.lit(ARABIC))
    share = arabic / F.nullif(F.length(F.trim(c)), F.lit(0))
    bad = (letters / F.nullif(F.size(ws), F.lit(0)) <= 2) | F.exists(ws, lambda w: (F.length(w) == 1) & w.rlike(ARABIC)) | c.rlike(r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]") | (share > 0.1)
    return F.coalesce((F.trim(c) != "") & (arabic > 0) & bad, F.lit(False))


def ordinals() -> dict[str, int]:
    """Ordinal words, without and with article, to 99: longer ones first, so that none is read as a shorter one inside it."""
    out: dict[str, int] = {}
    for units, eleventh, ten in ((UNITS_M, ELEVENTH_M, TEN_M), (UNITS_F, ELEVENTH_F, TEN_F)):
        for i, u in enumerate(units, 1):
            out[u] = i
        teens = (eleventh, *units[1:9])
        for i, u in enumerate(teens, 1):
            out[f"{u} {ten}"] = 10 + i
            for t, tens in enumerate(TENS, 2):
                out[f"{u} وال{tens}"] = 10 * t + i
    for t, tens in enumerate(TENS, 2):
        out[tens] = 10 * t
    out |= {f"ال{k}": v for k, v in out.items()}
    out |= {k.replace("أ", "ا"): v for k, v in out.items()}
    return dict(sorted(out.items(), key=lambda kv: (-len(kv[0]), kv[0])))


HUNDRED = ("مائة", "مئة")
TWO_HUNDREDS = ("مائتان", "مائتين", "مئتان", "مئتين")
HUNDREDS = ("ثلاث", "أربع", "خمس", "ست", "سبع", "ثمان", "تسع")
ONE, AFTER, REPEATED = ("واحد", "واحدة"), "بعد", ("مكرر", "مكررا", "مكررة")


def number_words() -> dict[str, tuple[int, int]]:
    """The words that numbers of headings are made of, with value and rank: units 1, ten 2, tens 3, hundreds 4. In a number each word's rank is above that of the word before."""
    out = {w: (1, 1) for w in (ELEVENTH_M, ELEVENTH_F, *ONE)}
    for units in (UNITS_M, UNITS_F):
        out |= {u: (i, 2 if i == 10 else 1) for i, u in enumerate(units, 1)}
    out |= {TEN_M: (10, 2), TEN_F: (10, 2)}
    for i, tens in enumerate(TENS, 2):
        out |= {tens: (10 * i, 3), tens[:-2] + "ين": (10 * i, 3)}
    out |= {w: (100, 4) for w in HUNDRED} | {w: (200, 4) for w in TWO_HUNDREDS}
    out |= {u + h: (100 * i, 4) for i, u in enumerate(HUNDREDS, 3) for h in HUNDRED}
    return {k.replace("أ", "ا"): v for k, v in out.items()}


def ordinal_number(c: Column) -> Column:
    """The number of a heading: its digits (Arabic-Indic ones too), else that of its first number in words, to 999; null without either.

    The words of a number are added up one by one: units, ten or tens, hundreds (also behind "after"), each with or without "and" and article. A word that can't follow ends the number; words for repeated articles are passed over.
    """
    table = number_words()
    lookup = lambda i: F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[i])))
    bare = lambda w: F.translate(F.regexp_replace(w, "[^ء-ي]", ""), "أ", "ا")

    def known(w: Column) -> Column:
        """The word without "and" and article, if it is one of the table's as it stands or without them."""
        forms = (bare(w), F.regexp_replace(bare(w), "^و", ""), F.regexp_replace(bare(w), "^و?ال", ""))
        return F.coalesce(*(F.when(F.map_contains_key(lookup(0), f), f) for f in forms))

    tokens = F.transform(F.filter(F.split(c, r"\s+"), lambda w: bare(w) != ""), lambda w: F.struct(known(w).alias("k"), bare(w).isin(AFTER, *REPEATED).alias("between")))

    def step(s: Column, t: Column) -> Column:
        value, rank = F.try_element_at(lookup(0), t["k"]), F.try_element_at(lookup(1), t["k"])
        goes_on = ~s["done"] & rank.isNotNull() & (rank > s["rank"])
        ends = (s["rank"] > 0) & ~goes_on & ~t["between"]
        return F.struct(F.when(goes_on, s["n"] + value).otherwise(s["n"]).alias("n"), F.when(goes_on, rank).otherwise(s["rank"]).alias("rank"), (s["done"] | ends).alias("done"))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("rank"), F.lit(False).alias("done"))
    words_ = F.nullif(F.aggregate(tokens, none, step, lambda s: s["n"]), F.lit(0))
    digits = F.nullif(F.translate(F.regexp_extract(c, r"[0-9٠-٩]+", 0), "٠١٢٣٤٥٦٧٨٩", "0123456789"), F.lit("")).try_cast("int")
    return F.coalesce(digits, words_)


def with_digits(c: Column) -> Column:
    """Ordinal words in a text as digits, longer ones first, so that none is replaced inside a longer one."""
    table = ordinals()
    number = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    pattern = "(?<![ء-ي])(?:" + "|".join(re.escape(k).replace("\\ ", r"\s+") for k in table) + ")(?![ء-ي])"
    words_, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
    digits = F.transform(words_, lambda w: F.try_element_at(number, F.regexp_replace(w, r"\s+", " ")).cast("string"))
    return F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(digits, i), F.lit(""))))), "")
