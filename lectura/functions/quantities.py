"""Quantity grammars as column expressions over normalised text.

num reads a head as a number and unit a token as a unit; a caller that reads many heads of a text passes its own, so that the
large expressions behind them stand once in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import WORDS, number
from .readings import quantity, reading
from .text import ending, let
from .units import meant, unit_of

NUMBER = r"[+-]?[0-9.][0-9.,_]*(?: ?[¼½¾⅓⅔⅛⅜⅝⅞])?"
CJK = r"[〇零一二三四五六七八九壱弐参十百千万億兆0-9.,]+"
# Traditional measures in metres and square metres.
SHAKU, SUN, KEN, TATAMI, TSUBO = 10.0 / 33.0, 1.0 / 33.0, 60.0 / 33.0, 1.62, 400.0 / 121.0


#: Ways to write the number before a unit: digits, digits grouped by blanks, with large units, CJK numerals, words.
HEADS = (
    r"[+-]?[0-9]{1,3}(?:[ \u00a0\u202f\u2009][0-9]{3})+(?:[.,][0-9]+)?",
    r"[0-9][0-9.,]*[万億兆][0-9〇零一二三四五六七八九壱弐参十百千万億兆.,]*",
    NUMBER,
    r"[〇零一二三四五六七八九壱弐参十百千万億兆]+",
    rf"(?i:(?:(?:{'|'.join([*WORDS, 'hundred', 'thousand', 'and'])})[ -])*(?:{'|'.join([*WORDS, 'hundred', 'thousand'])})(?= ))",
)
NUMBER_UNIT = rf"^({'|'.join(HEADS)}) *([^0-9.,_\s+-].*)$"


def split_number_unit(text: Column) -> tuple[Column, Column]:
    """The number a text begins with and the rest; empty where it doesn't begin with one."""
    return F.regexp_extract(text, NUMBER_UNIT, 1), F.regexp_extract(text, NUMBER_UNIT, 2)


def registered(value: Column, unit: Column) -> Column:
    read = lambda u: quantity(value * u["factor"], u["canonical"], u["dimension"], 0.98, approximate=u["approximate"], code=F.when(u["approximate"], "APPROXIMATION"))
    return let(unit, lambda u: F.when(u.isNotNull(), read(u)))


def typo_corrected(value: Column, token: Column, strictness: str, registry: tuple[str, ...] | None) -> Column:
    """A number with a misspelt unit: the unit meant, where one spelling is near enough. Unless forgiving, that needs a confirmation."""
    def told(m: Column) -> Column:
        fits = m.isNotNull() & value.isNotNull()
        if strictness != "forgiving":
            return reading("refused", fits, code="TYPO_CORRECTED", suggestion=m["unit"])
        read = quantity(value * m["factor"], m["canonical"], m["dimension"], 0.82, approximate=m["approximate"], code="TYPO_CORRECTED", suggestion=m["unit"])
        return F.when(fits, read)

    return let(meant(token, registry), told)


def compound(text: Column, number_format: str = "auto") -> Column:
    """Two or more pairs of number and unit of one dimension, in falling order, each below the unit above it: their sum.

    A part that reaches the unit above it is refused, not rounded up.
    """
    shape = rf"^{NUMBER} \S+( {NUMBER} \S+)+$"
    parts = F.filter(F.split(text, " +"), lambda p: p != "")
    pair = lambda ps, i: F.struct(number(F.get(ps, i * 2), number_format).alias("value"), unit_of(F.get(ps, i * 2 + 1)).alias("unit"))
    pairs = let(parts, lambda ps: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(ps) / 2).cast("int") - 1)), lambda i: pair(ps, i)))
    return F.when(text.rlike(shape), let(pairs, _summed))


def _summed(pairs: Column) -> Column:
    first = F.get(pairs, F.lit(0))["unit"]
    whole = F.forall(pairs, lambda p: p["value"].isNotNull() & (p["unit"]["canonical"] == first["canonical"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("above"), F.lit(True).alias("inside"))

    def step(acc, p):
        part, factor = p["value"] * p["unit"]["factor"], p["unit"]["factor"]
        inside = (factor < acc["above"]) & (F.abs(part) < acc["above"] * (1 - 1e-9))
        return F.struct((acc["sum"] + part).alias("sum"), factor.alias("above"), (acc["inside"] & inside).alias("inside"))

    read = let(F.aggregate(pairs, start, step), lambda f: F.when(f["inside"], quantity(f["sum"], first["canonical"], first["dimension"], 0.94)).otherwise(reading("refused", F.lit(True), code="COMPOUND_OVERFLOW")))
    return F.when(F.coalesce(whole, F.lit(False)), read)


def temperature(text: Column, num=number) -> Column:
    head = F.coalesce(F.nullif(F.when(ending(text).rlike("(?i)[cfk]$"), F.regexp_extract(text, r"(?i)^(.+?) ?(?:°|º)? ?[cfk]$", 1)), F.lit("")), F.nullif(F.regexp_extract(text, r"^(?:摂氏|華氏)(.+)度$", 1), F.lit("")))
    scale = F.coalesce(F.nullif(F.upper(F.regexp_extract(ending(text), r"(?i)(?:°|º)? ?([cfk])$", 1)), F.lit("")), F.when(text.startswith("摂氏"), "C").when(text.startswith("華氏"), "F"))
    celsius = let(num(F.regexp_replace(head, "[°º ]+$", "")), lambda v: F.when(scale == "C", v).when(scale == "F", (v - 32.0) * 5.0 / 9.0).when(scale == "K", v - 273.15))
    return quantity(celsius, "C", "temperature", 0.95)


def japanese_length(text: Column, num=number) -> Column:
    """尺, 寸 and 間 in a row; 半 behind 間 or 尺 adds a half of it."""
    shape = r"^(?:([0-9.,]+)間(半)?)?(?:([0-9.,]+)尺(半)?)?(?:([0-9.,]+)寸)?$"
    part = lambda i: F.when(F.regexp_extract(text, shape, i) == "", 0.0).otherwise(num(F.regexp_extract(text, shape, i)))
    half = lambda i: F.when(F.regexp_extract(text, shape, i) == "半", 0.5).otherwise(0.0)
    total = (part(1) + half(2)) * KEN + (part(3) + half(4)) * SHAKU + part(5) * SUN
    return F.when(text.rlike(shape) & text.rlike("[間尺寸]"), quantity(total, "m", "length", 0.98, approximate=F.lit(True), code="APPROXIMATION"))


def traditional_area(text: Column, num=number) -> Column:
    """帖, 畳 (半 adds a half) and 坪, as square metres; by convention, so approximate."""
    mats, half = F.regexp_extract(text, rf"^({CJK})[帖畳](半?)$", 1), F.regexp_extract(text, rf"^({CJK})[帖畳](半?)$", 2)
    tsubo = F.regexp_extract(text, rf"^({CJK})坪$", 1)
    area = F.when(mats != "", (num(mats) + F.when(half == "半", 0.5).otherwise(0.0)) * TATAMI).when(tsubo != "", num(tsubo) * TSUBO)
    return quantity(area, "m2", "area", 0.94, approximate=F.lit(True), code="APPROXIMATION")


def square_metres(text: Column, num=number) -> Column:
    head = F.regexp_extract(text, rf"^(?:延床|延べ床)?({CJK}) *(?:㎡|m2|m\^2|平米)$", 1)
    return quantity(F.when(head != "", num(head)), "m2", "area", 0.99)


def metric_idiom(text: Column, num=number) -> Column:
    """1m80: metres, then centimetres."""
    shape = r"^([0-9.,]+)m([0-9][0-9.,_]*)$"
    return quantity(F.when(text.rlike(shape), num(F.regexp_extract(text, shape, 1)) + num(F.regexp_extract(text, shape, 2)) * 0.01), "m", "length", 0.97)


def feet_inches(text: Column, num=number) -> Column:
    """Feet and, below twelve, inches: 5ft 11, 5'11\"."""
    shape = r"""(?i)^([0-9.,]+) ?(?:feet|foot|ft|'|′)(?: ?([0-9.,]+) ?(?:inches|inch|in|"|″|'')?)?$"""
    inches = F.regexp_extract(text, shape, 2)
    extra = F.when(inches == "", 0.0).otherwise(num(inches))
    return quantity(F.when(text.rlike(shape), let(extra, lambda e: F.when(e < 12, num(F.regexp_extract(text, shape, 1)) * 0.3048 + e * 0.0254))), "m", "length", 0.97)


def cups(text: Column, locale: str | None = None, num=number) -> Column:
    """A cup is as large as the locale says; the other sizes are the alternatives."""
    sizes = {"en-US": 0.2365882365, "en-GB": 0.284130625, "metric": 0.25}
    best = locale if locale in sizes else "metric" if locale == "ja" else "en-US"
    others = lambda n: F.array(*[n * v for k, v in sizes.items() if k != best])
    n = num(F.regexp_extract(text, r"(?i)^(.+?) ?cups?$", 1))
    return let(n, lambda n: quantity(n * sizes[best], "L", "volume", 0.72, code="AMBIGUOUS_UNIT", others=others(n)))


def convert(text: Column, num=number, unit=unit_of) -> Column:
    """X unit to unit, within one dimension; the unit of the result is the one asked for."""
    shape = rf"^({NUMBER}) *(.+?) (?:to|in|into|as) (.+)$"
    value = num(F.regexp_extract(text, shape, 1))
    read = lambda a, b: F.when(a["canonical"] == b["canonical"], quantity(value * a["factor"] / b["factor"], b["unit"], b["dimension"], 0.95))
    return F.when(text.rlike(shape), let(unit(F.regexp_extract(text, shape, 2)), lambda a: let(unit(F.regexp_extract(text, shape, 3)), lambda b: read(a, b))))
