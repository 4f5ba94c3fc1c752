"""Numbers in text as column expressions: null where a text isn't one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, let, trimmed

# The words of the number language.
WORDS = {"a": 1, "an": 1, "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
FRACTIONS = {"¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8}
CJK_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "壱": 1, "弐": 2, "参": 3}
PLACES = {"十": 10, "百": 100, "千": 1000}
MYRIADS = {"兆": 1e12, "億": 1e8, "万": 1e4}

#: All that a number is written with: words and blanks, or digits, numerals, fractions, separators and blanks.
NO_MIX = rf"^(?:[a-zA-Z][a-zA-Z -]*+|[0-9.,+_'\-\p{{IsWhite_Space}}{''.join([*FRACTIONS, *CJK_DIGITS, *PLACES, *MYRIADS])}]*+)$"
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def _cast(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(PLAIN), t.try_cast("double")))


def locale_number(text: Column, number_format: str = "auto") -> Column:
    """Digits with separators. auto: the rightmost of both separators is the decimal one; a single kind groups only if it groups by threes."""
    first = F.regexp_replace(trimmed(text), r"^([+-]) +", "$1")
    return let(first, lambda t: let(_spaced(t), lambda spaced: _separated(spaced, number_format)))


def _spaced(t: Column) -> Column:
    """Without the blanks, apostrophes and underscores that group by threes."""
    blank = r"[ \u00a0\u202f\u2009_']"
    grouped = rf"^[+-]?[0-9]{{1,3}}({blank}[0-9]{{3}})+([.,][0-9]*)?$"
    return F.when(t.rlike(grouped), F.regexp_replace(t, blank, "")).otherwise(t)


def _separated(spaced: Column, number_format: str) -> Column:
    no_dot, no_comma = F.replace(spaced, F.lit("."), F.lit("")), F.replace(spaced, F.lit(","), F.lit(""))
    comma_decimal = F.replace(no_dot, F.lit(","), F.lit("."))
    western, indian = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$", r"^[+-]?[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}(\.[0-9]*)?$"
    european, single_comma = r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]*)?$", r"^[+-]?[0-9]*,[0-9]*$"
    plain = _cast(spaced)
    if number_format == "comma_decimal":
        return F.when(spaced.rlike(european), _cast(comma_decimal)).when(spaced.rlike(single_comma), _cast(comma_decimal)).when(~F.contains(spaced, F.lit(".")), plain)
    if number_format == "dot_decimal":
        return F.when(spaced.rlike(western) | spaced.rlike(indian), _cast(no_comma)).when(~F.contains(spaced, F.lit(",")), plain)
    both = F.contains(spaced, F.lit(",")) & F.contains(spaced, F.lit("."))
    return (
        F.when(spaced.rlike("^[0-9]+$"), spaced.try_cast("double"))
        .when(spaced.rlike(western) | spaced.rlike(indian), _cast(no_comma))
        .when(both & spaced.rlike(european), _cast(comma_decimal))
        .when(spaced.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3}){2,}$"), _cast(no_dot))
        .when(~F.contains(spaced, F.lit(".")) & spaced.rlike(single_comma), _cast(comma_decimal))
        .otherwise(plain)
    )


def fraction_number(text: Column) -> Column:
    whole, sign = F.regexp_extract(text, r"^([0-9]*) ?([¼½¾⅓⅔⅛⅜⅝⅞])$", 1), F.regexp_extract(text, r"^([0-9]*) ?([¼½¾⅓⅔⅛⅜⅝⅞])$", 2)
    return F.when(sign != "", F.coalesce(whole.try_cast("double"), F.lit(0.0)) + F.try_element_at(_table(FRACTIONS), sign))


def english_number(text: Column) -> Column:
    """Number words: hundred multiplies what came since the last thousand, thousand closes a group."""
    words = F.filter(F.split(F.regexp_replace(F.replace(ascii_lower(trimmed(text)), F.lit("-"), F.lit(" ")), r"\band\b", " "), " +"), lambda w: w != "")
    known = _table(WORDS)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("group"), F.lit(True).alias("ok"))

    def step(acc, w):
        value = F.try_element_at(known, w)
        return F.struct(
            F.when(w == "thousand", acc["total"] + acc["group"] * 1000).otherwise(acc["total"]).alias("total"),
            F.when(w == "thousand", F.lit(0.0)).when(w == "hundred", acc["group"] * 100).otherwise(acc["group"] + F.coalesce(value, F.lit(0.0))).alias("group"),
            (acc["ok"] & (value.isNotNull() | w.isin("hundred", "thousand"))).alias("ok"),
        )

    return let(words, lambda ws: let(F.aggregate(ws, start, step), lambda f: F.when((F.size(ws) > 0) & f["ok"], f["total"] + f["group"])))


def cjk_section(text: Column) -> Column:
    """Up to 千: a digit before a place multiplies it; with 〇 or 零 the digits are positional."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    digits = F.translate(text, "".join(CJK_DIGITS), "".join(map(str, CJK_DIGITS.values())))
    positional = F.when(text.rlike("[〇零]") & digits.rlike("^[0-9]+$"), digits.try_cast("double"))
    value = _table(CJK_DIGITS)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("digit"), F.lit(10000.0).alias("place"), F.lit(True).alias("ok"))

    def step(acc, c):
        place, digit = F.try_element_at(_table(PLACES), c), F.try_element_at(value, c)
        is_place = place.isNotNull()
        return F.struct(
            F.when(is_place, acc["sum"] + F.when(acc["digit"] < 0, 1.0).otherwise(acc["digit"]) * place).otherwise(acc["sum"]).alias("sum"),
            F.when(is_place, F.lit(-1.0)).otherwise(F.coalesce(digit, F.lit(-1.0))).alias("digit"),
            F.when(is_place, place).otherwise(acc["place"]).alias("place"),
            (acc["ok"] & F.when(is_place, place < acc["place"]).otherwise(digit.isNotNull() & (acc["digit"] < 0))).alias("ok"),
        )

    multiplied = let(F.aggregate(chars, start, step), lambda f: F.when(f["ok"], f["sum"] + F.greatest(f["digit"], F.lit(0.0))))
    return F.when(text != "", F.coalesce(positional, multiplied))


def large_number(text: Column) -> Column:
    """Heads of 兆, 億 and 万 in that order, each a CJK or plain number, an empty head one."""
    pattern = r"^(?:([^兆億万]*)兆)?(?:([^兆億万]*)億)?(?:([^兆億万]*)万)?([^兆億万]*)$"
    total = F.lit(0.0)
    for i, (name, factor) in enumerate(MYRIADS.items(), 1):
        value = let(F.regexp_extract(text, pattern, i), lambda h: F.when(h == "", 1.0).otherwise(F.coalesce(cjk_section(h), locale_number(h))))
        total = total + F.when(F.contains(text, F.lit(name)), value).otherwise(0.0) * factor
    last = let(F.regexp_extract(text, pattern, 4), lambda h: F.when(h == "", 0.0).otherwise(F.coalesce(cjk_section(h), locale_number(h))))
    return F.when(text.rlike("[兆億万]") & text.rlike(pattern), total + last)


def number(text: Column, number_format: str = "auto") -> Column:
    """Large units, then a vulgar fraction, number words, CJK numerals, separators: the first that reads. Never infinite."""
    return let(trimmed(text), lambda t: F.when(t.rlike(NO_MIX), let(_number(t, number_format), lambda n: F.when(F.abs(n) < float("inf"), n))))


def _number(t: Column, number_format: str) -> Column:
    cjk = F.when(t.rlike("^[〇零一二三四五六七八九壱弐参十百千]+$"), cjk_section(t))
    words = F.when(t.rlike("(?i)^[a-z][a-z -]*$"), english_number(t))
    # digits and separators alone are none of the others
    beside = F.when(t.rlike("[^0-9.,+-]"), F.coalesce(F.when(t.rlike("[兆億万]"), large_number(t)), fraction_number(t), words, cjk))
    return F.coalesce(beside, locale_number(t, number_format))


def competing_numbers(text: Column) -> tuple[Column, Column]:
    """Both readings of a single separator before three digits: as decimal and as grouping; null elsewhere."""
    t = trimmed(text)
    shape = t.rlike(r"^[+-]?[0-9]{1,3}[.,][0-9]{3}$")
    grouped = F.when(shape, F.regexp_replace(t, "[.,]", "").try_cast("double"))
    decimal = F.when(shape, F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
    comma = F.contains(t, F.lit(","))
    return F.when(comma, grouped).otherwise(decimal), F.when(comma, decimal).otherwise(grouped)
