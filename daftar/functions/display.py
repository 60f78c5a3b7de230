"""Arabic text as it is displayed: joining forms of letters, and the order of the bidirectional rule, both as columns.

Joining: a letter has up to four presentation forms, and takes the one that its neighbours ask for. Forms come from Unicode's decompositions.

Order: each character has a bidirectional class, and the rules for numbers, neutrals and levels work on the text of classes, one letter a
character, run by run, in Arrow batches; lines of the same classes are worked out once a worker. Left out: explicit embedding marks (their characters count as
neutral) and the later rule for pairs of brackets. Tabs count as spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TATWEEL, LAM = "ـ", "ل"
#: Marks above and below letters, which take no part in joining.
_HARAKAT = re.compile("[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed]")
_ARABIC = re.compile("[\u0600-\u06ff]")


@lru_cache(maxsize=1)
def joining_forms() -> dict[str, dict[str, str]]:
    """For isolated, final, initial and medial: letter to form; the ligatures of lam and alef are letters under their isolated form."""
    out: dict[str, dict[str, str]] = {k: {} for k in ("isolated", "final", "initial", "medial")}
    for code in (*range(0xFB50, 0xFBB2), *range(0xFBD3, 0xFC00), *range(0xFE80, 0xFEFD)):
        tag, *letters = unicodedata.decomposition(chr(code)).split() or ("",)
        if tag[1:-1] in out and len(letters) == 1:
            out[tag[1:-1]].setdefault(chr(int(letters[0], 16)), chr(code))
    for code in range(0xFEF5, 0xFEFD, 2):
        out["isolated"][chr(code)], out["final"][chr(code)] = chr(code), chr(code + 1)
    return out


@lru_cache(maxsize=1)
def lam_alef() -> dict[str, str]:
    """Pairs of lam and alef and their isolated ligatures."""
    return {unicodedata.normalize("NFKC", chr(code)): chr(code) for code in range(0xFEF5, 0xFEFD, 2)}


def evaluated_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once for each row and not for each element that use looks at."""
    return F.get(F.transform(F.array(value), use), 0)


@lru_cache(maxsize=1)
def _joining() -> tuple[frozenset[str], frozenset[str], dict[str, dict[str, str]]]:
    """Letters that join what follows, letters that join what stands before, and the forms."""
    forms = joining_forms()
    return frozenset((TATWEEL, *forms["initial"])), frozenset((TATWEEL, *forms["final"])), forms


def _reshaped(text: str) -> str:
    if not _ARABIC.search(text):
        return text
    before, after, forms = _joining()
    plain = _HARAKAT.sub("", text)
    for pair, ligature in lam_alef().items():
        plain = plain.replace(pair, ligature)
    out, last = [], ""
    for x, following in zip(plain, (*plain[1:], "")):
        back, ahead = last in before and x in after, following in after and x in before
        out.append(forms["medial" if back and ahead else "final" if back else "initial" if ahead else "isolated"].get(x, x))
        last = x
    return "".join(out)


def _by_text(c: Column, of: Callable[[str], str]) -> Column:
    """of(text) in Arrow batches; null stays. Spark evaluates no such column over or inside one with lambda functions."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else of(t))

    return each(c)


def reshaped(c: Column) -> Column:
    """Letters as the presentation forms that their neighbours ask for, without marks; the inverse of base_letters for words written in letters."""
    return _by_text(c, _reshaped)


#: Letter of a bidirectional class on the text of classes; all other classes are neutral, `O`.
CLASSES = {"L": "L", "R": "R", "AL": "A", "EN": "E", "AN": "N", "ES": "S", "ET": "T", "CS": "C", "NSM": "M", "WS": "W", "S": "W", "B": "W"}
RIGHT_TO_LEFT = re.compile("[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc\U00010800-\U00010fff\U0001e800-\U0001efff]")
MIRRORS = str.maketrans("()[]{}<>«»‹›≤≥", ")(][}{><»«›‹≥≤")


class _ClassLetters(dict):
    """Class letters by code point, each looked up once. Characters beyond the first two planes count as neutral."""

    def __missing__(self, code: int) -> str:
        self[code] = CLASSES.get(unicodedata.bidirectional(chr(code)), "O") if code < 0x20000 else "O"
        return self[code]


_CLASS_LETTERS = _ClassLetters()


def _resolved(k: str, base: str) -> str:
    """Classes as L, R, E and N alone: the rules for marks, numbers and neutrals. base: L or R."""
    # Marks are of the class before them.
    k = re.sub("^M+", lambda m: base * len(m[0]), k)
    k = re.sub("([^M])M+", lambda m: m[1] * len(m[0]), k)
    # European numbers behind Arabic letters are Arabic numbers; then Arabic letters are as other right-to-left letters.
    k = re.sub("A[^LRA]*", lambda m: m[0].replace("A", "R").replace("E", "N"), k)
    # A separator between two numbers of a kind is part of them, and so are the terminators beside a European number.
    k = re.sub("(?<=N)C(?=N)", "N", re.sub("(?<=E)[SC](?=E)", "E", k))
    k = re.sub("T*ET*", lambda m: "E" * len(m[0]), k)
    k = re.sub("[STCW]", "O", k)
    # European numbers behind left-to-right letters are as these.
    k = re.sub("^[^LR]+|L[^LR]*" if base == "L" else "L[^LR]*", lambda m: m[0].replace("E", "L"), k)
    side = lambda x: "L" if x == "L" else "R"

    def neutral(m: re.Match) -> str:
        left, right = side(k[m.start() - 1] if m.start() else base), side(k[m.end()] if m.end() < len(k) else base)
        return (left if left == right else base) * len(m[0])

    return re.sub("O+", neutral, k)


@lru_cache(maxsize=1 << 13)
def _stretches(k: str) -> list[tuple[int, int, bool]]:
    """The stretches of a line of classes in the order in which they are displayed: from, to, whether turned around."""
    first = re.search("[LRA]", k)
    base = "R" if first and first[0] != "L" else "L"
    end = len(k.rstrip("W"))
    levels = _resolved(k, base).translate(str.maketrans("LREN", "0122" if base == "L" else "2122"))
    levels = levels[:end] + ("0" if base == "L" else "1") * (len(k) - end)
    out = []
    # Of what lies between two stretches of level 0 the order turns around.
    for outer in re.finditer("0+|[12]+", levels):
        inner = [(m.start(), m.end(), m[0][0] == "1") for m in re.finditer("0+|1+|2+", levels[: outer.end()][outer.start() :])]
        out += [(a + outer.start(), b + outer.start(), turned) for a, b, turned in reversed(inner)]
    return out


def _displayed(line: str) -> str:
    if not RIGHT_TO_LEFT.search(line):
        return line
    k = line.translate(_CLASS_LETTERS)
    found = _stretches(k) if len(k) <= 200 else _stretches.__wrapped__(k)  # long lines are hardly met again
    return "".join(line[a:b][::-1].translate(MIRRORS) if turned else line[a:b] for a, b, turned in found)


def displayed(c: Column) -> Column:
    """Each line of a text in the order in which it is displayed from left to right, brackets mirrored where the direction is right to left. The first letter gives a line's direction."""
    return _by_text(c, lambda t: "\n".join(map(_displayed, t.split("\n"))))


def fixed_arabic(c: Column) -> Column:
    """Words joined by one space, Arabic ones reshaped, in the order in which they are displayed; texts that are more than half Arabic stand between narrow spaces, as right-to-left text. Blank texts stay."""
    text = reshaped(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    share = F.regexp_count(text, F.lit("[؀-ۿ]")) / F.nullif(F.length(F.trim(text)), F.lit(0))
    return F.when(F.trim(c) == "", c).otherwise(displayed(F.when(share > 0.5, F.concat(F.lit("\u202f"), text, F.lit("\u202f"))).otherwise(text)))
