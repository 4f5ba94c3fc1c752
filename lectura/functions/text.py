"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\p{IsWhite_Space}]"
_FULL = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_HALF = "0123456789" + UPPER + LOWER
#: Characters of no width, which are dropped.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# Compatibility signs and what they stand for.
SIGNS = {"㍍": "m", "㌢": "cm", "㍉": "mm", "㌔": "km", "㌘": "g", "㎏": "kg", "㎎": "mg", "㎜": "mm", "㎝": "cm", "㎞": "km", "㏄": "cc"}


def let(value: Column, body) -> Column:
    """body of a value that it names once, however often it uses it: the expression doesn't grow with each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def ending(text: Column) -> Column:
    """A text's last characters: whether a short pattern stands at its end is seen there, without a search through all of it."""
    return F.right(text, F.lit(16))


def normalized(text: Column) -> Column:
    """Full width to ASCII, wide blanks to spaces, zero width characters dropped, compatibility signs spelt out; then trimmed."""
    out = F.translate(text, _FULL + "．。＋－−–／＊×＾％\u3000\u00a0", _HALF + "..+---/**^%  ")
    out = F.regexp_replace(out, f"[{ZERO_WIDTH}]", "")
    out = F.regexp_replace(out, r"([0-9][ ]*)[，、]", "$1,")
    for sign, plain in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return trimmed(out)
