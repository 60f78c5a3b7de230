"""Joining forms and display order against character-by-character statements of the rules on Unicode's data."""

import random
import unicodedata

from pyspark.sql import functions as F

from daftar.functions import display
from daftar.functions.arabic import base_letters

LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهويىةءآأإؤئپچژگکی"


def form(letter, tag):
    for code in (*range(0xFB50, 0xFC00), *range(0xFE70, 0xFEFD)):
        if unicodedata.decomposition(chr(code)) == f"<{tag}> {ord(letter):04X}":
            return chr(code)
    return None


def brute_reshaped(text):
    out, text = [], [c for c in text if not (unicodedata.category(c) == "Mn")]
    units, i = [], 0
    while i < len(text):
        pair = text[i] == "ل" and i + 1 < len(text) and text[i + 1] in "اأإآ"
        units.append("".join(text[i : i + 1 + pair]))
        i += 1 + pair
    joins_next = lambda u: u == "ـ" or len(u) == 1 and form(u, "initial") is not None
    joins_previous = lambda u: u == "ـ" or len(u) == 2 or form(u, "final") is not None
    for i, u in enumerate(units):
        back = i > 0 and joins_next(units[i - 1]) and joins_previous(u)
        ahead = i + 1 < len(units) and joins_next(u) and joins_previous(units[i + 1])
        tag = {(True, True): "medial", (True, False): "final", (False, True): "initial", (False, False): "isolated"}[back, ahead]
        if len(u) == 2:
            code = next(c for c in range(0xFEF5, 0xFEFD) if unicodedata.decomposition(chr(c)) == f"<{tag}> {ord(u[0]):04X} {ord(u[1]):04X}")
            out.append(chr(code))
        else:
            out.append(form(u, tag) or u)
    return "".join(out)


def brute_displayed(text):
    if not any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in text):
        return text
    k = [{"S": "WS", "B": "WS", "": "L"}.get(b := unicodedata.bidirectional(c), b) for c in text]
    k = [x if x in ("L", "R", "AL", "EN", "AN", "ES", "ET", "CS", "NSM", "WS") else "ON" for x in k]
    original = list(k)
    base = next((0 if x == "L" else 1 for x in k if x in ("L", "R", "AL")), 0)
    sor = "R" if base else "L"
    for i, x in enumerate(k):
        if x == "NSM":
            k[i] = k[i - 1] if i else sor
    strong = sor
    for i, x in enumerate(k):
        strong = x if x in ("L", "R", "AL") else strong
        if x == "EN" and strong == "AL":
            k[i] = "AN"
    k = ["R" if x == "AL" else x for x in k]
    for i in range(1, len(k) - 1):
        if k[i - 1] == k[i + 1] == "EN" and k[i] in ("ES", "CS") or k[i - 1] == k[i + 1] == "AN" and k[i] == "CS":
            k[i] = k[i - 1]
    for order in (range(1, len(k)), range(len(k) - 2, -1, -1)):
        for i in order:
            beside = k[i - 1] if order.step == 1 else k[i + 1]
            if k[i] == "ET" and beside == "EN":
                k[i] = "EN"
    k = ["ON" if x in ("ES", "ET", "CS", "WS") else x for x in k]
    strong = sor
    for i, x in enumerate(k):
        strong = x if x in ("L", "R") else strong
        if x == "EN" and strong == "L":
            k[i] = "L"
    i = 0
    while i < len(k):
        j = i
        while j < len(k) and k[j] == "ON":
            j += 1
        if j > i:
            side = lambda x: "L" if x == "L" else "R"
            left, right = side(k[i - 1]) if i else sor, side(k[j]) if j < len(k) else sor
            k[i:j] = [left if left == right else sor] * (j - i)
        i = max(j, i + 1)
    levels = [{"L": 0, "R": 1, "EN": 2, "AN": 2}[x] if base == 0 else {"R": 1, "L": 2, "EN": 2, "AN": 2}[x] for x in k]
    i = len(k)
    while i and original[i - 1] == "WS":
        i -= 1
        levels[i] = base
    mirror = dict(zip("()[]{}<>«»", ")(][}{><»«", strict=True))
    chars = [mirror.get(c, c) if level % 2 else c for c, level in zip(text, levels, strict=True)]
    order = list(range(len(k)))
    for level in (2, 1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(chars[i] for i in order)


def column(spark, texts, of):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r.v for r in spark.createDataFrame(rows, "i int, t string").select("i", of(F.col("t")).alias("v")).orderBy("i").collect()]


def test_reshaped_letters(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice(LETTERS + "ـلا") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["مُحَمَّد", "لا إله", "abc", "", "بa ب😀ب", "1ب2"]
    got = column(spark, words, display.reshaped)
    assert got == [brute_reshaped(w) if any("؀" <= c <= "ۿ" for c in w) else w for w in words]
    plain = [w for w in words if not any(unicodedata.category(c) == "Mn" for c in w)]
    assert column(spark, plain, lambda c: base_letters(display.reshaped(c))) == plain  # the inverse
    assert column(spark, [None], display.reshaped) == [None]


def test_display_order(spark):
    rng = random.Random(2)
    parts = ["abc", "سلام", "ד", "12", "٣٤", "1,2.5", "٣,٤", "+7-", "50%", "$3", " ", "  ", "(", ")", "[x]", "!", "é́", "بّ", ".", "/", "😀", "«", "»", "ﻣﺮ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(600)] + ["", "abc def", "السعر 12.5% (abc) نهاية ", "\n".join(["abc ب", "ب abc", "", "12"])]
    assert column(spark, texts, display.displayed) == ["\n".join(brute_displayed(x) for x in t.split("\n")) for t in texts]


def test_fixed_arabic(spark):
    texts = ["سلام  عليكم 5", "hello  world", "  ", None, "the كتاب book"]
    want = [brute_displayed(" ".join(brute_reshaped(w) for w in t.split())) if t and t.strip() else t for t in texts]
    assert column(spark, texts, display.fixed_arabic) == want


def test_many_names_in_one_task(spark):
    """Short texts with numbers behind them, by the tens of thousands: 0.6 ms a row would take 30 s."""
    import time

    rows = spark.range(0, 50_000, 1, 1).select("id", F.concat_ws(" ", display.reshaped(F.translate(F.concat(F.lit("bcd "), F.col("id").cast("string")), "bcd", "بجد")), F.col("id").cast("string")).alias("t"))
    began = time.time()
    got = rows.select("id", display.displayed(F.col("t")).alias("v")).collect()
    assert time.time() - began < 15
    assert [r.v for r in got if r.id % 5000 == 7] == [brute_displayed(f"{brute_reshaped(f'بجد {i}')} {i}") for i in range(7, 50_000, 5000)]
