"""Stretches of free text that may hold a measure: Python over a column's Arrow batches, in time linear in a text's length."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of numbers, of what continues a number, and of units.
DIGIT = "0-9０-９〇零一二三四五六七八九十百千壱弐参"
BODY = DIGIT + r"_'.,+\-．，万億兆/／"
UNIT = "A-Za-zＡ-Ｚａ-ｚμµ°%/^²³₂尺寸間帖畳坪平米㎡円度キログラム公斤千克リットル半"
SIGN = "$€£¥￥"
BLANK = r"(?:(?![\n\t])\s)"

_start = rf"(?:約(?=[{DIGIT}{SIGN}]))?(?:[{SIGN}](?=[{BODY}])|(?=[{DIGIT}]))"
_grouped = rf"(?<=[{DIGIT}]){BLANK}+(?=[{DIGIT}])"


def _window(grouping: bool, unit_behind_blank: bool) -> re.Pattern:
    gap, between = (f"|{_grouped}" if grouping else ""), (f"{BLANK}*" if unit_behind_blank else "")
    two_words = rf"{BLANK}*square {BLANK}*(?:meters?|metres?|feet)(?![A-Za-z])|" if unit_behind_blank else ""
    return re.compile(rf"{_start}[{BODY}](?:[{BODY}]{gap})*(?:{two_words}{between}[{UNIT}](?:[{BODY}{UNIT}]{gap})*)?")


#: The widest window crosses blanks between digits and before a unit; narrower ones guess less.
WIDEST, NARROWER = _window(True, True), (_window(True, False), _window(False, False))
IDENTIFIER = re.compile(r"[_A-Za-z0-9Ａ-Ｚａ-ｚ０-９]")
CUT = re.compile(r"[、;；\n\t,]")
# Labels in front of a value and the dimension that they stand for.
LABELS = {
    "area": re.compile(r"(?:延床|延べ床|床面積|敷地面積|面積|(?<![a-z0-9])(?:area|floor ?area|site ?area))$"),
    "length": re.compile(r"(?:寸法|幅|高さ|壁厚|厚さ|長さ|奥行き?|(?<![a-z0-9])(?:w|h|d|width|height|depth|length|wall ?thickness))$"),
}
LABEL_END = " \t　 :：=＝-ー―–—"
LABEL_CHARS = 40
WINDOWS = "array<struct<clause:int,at:int,char_start:int,start:bigint,hint:string,ways:array<string>>>"


def clauses(text: str):
    """(start, end) of the stretches between separators; a comma between digits separates nothing."""
    start = 0
    for m in CUT.finditer(text):
        i = m.start()
        if m[0] == ",":
            a, b = i - 1, i + 1
            while a >= 0 and text[a].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            if a >= 0 and b < len(text) and text[a] in "0123456789" and text[b] in "0123456789":
                continue
        yield start, i
        start = i + 1
    yield start, len(text)


def hint_of(before: str) -> str | None:
    """The dimension that a label at the end of what stands before a value names."""
    low = before.rstrip(LABEL_END).lower()
    return next((dimension for dimension, label in LABELS.items() if label.search(low)), None)


def windows_of(text: str | None) -> list[dict]:
    """The candidates of a text, in order and apart: place, label and windows, the widest first."""
    text, out, chars, size = text or "", [], 0, 0
    for clause, (a, b) in enumerate(clauses(text)):
        for at, m in enumerate(WIDEST.finditer(text, a, b)):
            start = m.start()
            hint = hint_of(text[max(a, start - LABEL_CHARS) : start])
            if hint is None and start > a and IDENTIFIER.match(text[start - 1]):
                continue
            ways = [m[0]]
            for narrower in NARROWER:
                n = narrower.match(text, start, b)
                if n and len(n[0]) < len(ways[-1]):
                    ways.append(n[0])
            size += len(text[chars:start].encode("utf-8", "surrogatepass"))
            chars = start
            out.append({"clause": clause, "at": at, "char_start": start, "start": size, "hint": hint, "ways": ways})
    return out


def windows(text: Column) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(windows_of)

    return F.pandas_udf(each, WINDOWS)(text)
