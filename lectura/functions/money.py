"""Money as column expressions: codes, symbols, minor units, and conversion by given rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number
from .readings import quantity
from .text import ending, let

# Signs and words that name one currency; $ and cents may be others too.
CODES = "USD EUR GBP JPY CNY KRW INR AUD CAD CHF"
PREFIXES = {"€": "EUR", "£": "GBP", "¥": "JPY", "￥": "JPY", "₩": "KRW", "₹": "INR"}
SUFFIXES = {"円": "JPY", "yen": "JPY", "euro": "EUR", "euros": "EUR", "€": "EUR", "quid": "GBP", "元": "CNY", "won": "KRW", "rupees": "INR", "francs": "CHF"}
MINOR = {"pence": "GBP", "penny": "GBP"}
DOLLARS = ("USD", "CAD", "AUD")


def currency(text: Column, num=number) -> Column:
    codes, end = CODES.replace(" ", "|"), ending(text)
    # a head is looked for only where what has to follow it ends the text
    n = lambda pattern, applies=F.lit(True): num(F.when(applies, F.regexp_extract(text, pattern, 1)))
    ends = lambda pattern: end.rlike(rf"(?i){pattern}$")
    before, after = rf"(?i)^(?:{codes}) ?(.+)$", rf"(?i)^(.+?) ?(?:{codes})$"
    code = F.upper(F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i)^({codes})", 1), F.lit("")), F.regexp_extract(end, rf"(?i)({codes})$", 1)))
    with_code = ends(f"(?:{codes})")
    out = F.when(text.rlike(before), quantity(n(before), code, "currency", 0.95)).when(with_code & text.rlike(after), quantity(n(after, with_code), code, "currency", 0.95))
    for sign, unit in PREFIXES.items():
        out = out.when(text.startswith(sign), quantity(n(rf"^\Q{sign}\E ?(.+)$"), unit, "currency", 0.95))
    for word, unit in SUFFIXES.items():
        there = ends(rf"\Q{word}\E")
        out = out.when(there & text.rlike(rf"(?i)^.+?\Q{word}\E$"), quantity(n(rf"(?i)^(.+?) ?\Q{word}\E$", there), unit, "currency", 0.93))
    for word, unit in MINOR.items():
        there = ends(f" {word}")
        out = out.when(there & text.rlike(rf"(?i)^.+ {word}$"), quantity(n(rf"(?i)^(.+) {word}$", there) / 100, unit, "currency", 0.93))
    in_cents = ends(" cents?")
    cents, dollars = n(r"(?i)^(.+) cents?$", in_cents) / 100, F.coalesce(n(r"^\$ ?(.+)$"), n(r"(?i)^(.+) dollars?$", ends(" dollars?")))
    out = out.when(in_cents & text.rlike(r"(?i)^.+ cents?$"), let(cents, lambda c: quantity(c, DOLLARS[0], "currency", 0.67, code="AMBIGUOUS_CURRENCY", others=F.array(c, c))))
    return out.when(text.startswith("$") | ends("dollars?"), let(dollars, lambda d: quantity(d, DOLLARS[0], "currency", 0.74, code="AMBIGUOUS_CURRENCY", others=F.array(d, d))))


def exchange(text: Column, rates: list[tuple[str, str, float]], num=number) -> Column:
    """USD 10 to JPY, by a rate given for just this direction. Rates are a short list of literals."""
    shape = r"(?i)^([a-z]{3}) ?(.+?) to ([a-z]{3})$"
    source, target = F.upper(F.regexp_extract(text, shape, 1)), F.upper(F.regexp_extract(text, shape, 3))
    rate = F.lit(None).cast("double")
    for a, b, factor in rates:
        rate = F.when((source == a.strip().upper()) & (target == b.strip().upper()), F.lit(float(factor))).otherwise(rate)
    return quantity(F.when(text.rlike(shape), num(F.regexp_extract(text, shape, 2)) * rate), target, "currency", 0.91)
