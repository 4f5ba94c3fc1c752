"""Places of normalised text in the original: which bytes a stretch of it was written as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, SIGNS, ZERO_WIDTH, let

#: Characters that don't become exactly one character each.
UNEVEN = f"[{ZERO_WIDTH}{''.join(k for k, v in SIGNS.items() if len(v) != 1)}]"
_WIDE = "".join(k for k, v in SIGNS.items() if len(v) == 2)


def emitted(char: Column) -> Column:
    """How many characters a character is normalised to."""
    return F.when(char.rlike(f"^[{ZERO_WIDTH}]$"), 0).when(char.rlike(f"^[{_WIDE}]$"), 2).otherwise(1)


def lead(original: Column) -> Column:
    """How many normalised characters are trimmed in front: blanks, with characters of no width among them."""
    front = F.regexp_extract(original, f"^(?:{BLANK}|[{ZERO_WIDTH}])*", 0)
    return F.length(F.regexp_replace(front, f"[{ZERO_WIDTH}]", ""))


def original_place(original: Column, first: Column, last: Column) -> Column:
    """start, end (in bytes of the original) and text of the characters from first up to last of the normalised, trimmed text.

    A character that was expanded belongs to a stretch as a whole, one of no width only where it stands inside it. One pass over
    the text; texts whose characters all stay single need none.
    """
    shift = lead(original)

    def even(a: Column, b: Column) -> Column:
        return F.struct(a.alias("from"), b.alias("to"))

    def uneven(a: Column, b: Column) -> Column:
        none = F.lit(-1)
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), none.alias("from"), none.alias("to"))

        def step(s: Column, c: Column) -> Column:
            then = s["n"] + emitted(c)
            return F.struct(
                then.alias("n"),
                (s["i"] + 1).alias("i"),
                F.when((s["from"] < 0) & (then > a), s["i"]).otherwise(s["from"]).alias("from"),
                F.when((s["n"] < b) & (then >= b), s["i"] + 1).otherwise(s["to"]).alias("to"),
            )

        at_end = lambda s: F.when(s["from"] < 0, s["i"]).otherwise(s["from"])
        return F.aggregate(F.filter(F.split(original, ""), lambda c: c != ""), begin, step, lambda s: even(at_end(s), F.greatest(at_end(s), s["to"])))

    def told(x: Column) -> Column:
        before, text = F.substring(original, F.lit(1), x["from"]), F.substring(original, x["from"] + 1, x["to"] - x["from"])
        return let(F.octet_length(before).cast("long"), lambda start: F.struct(start.alias("start"), (start + F.octet_length(text)).alias("end"), text.alias("text")))

    a, b = first + shift, last + shift
    return let(F.when(original.rlike(UNEVEN), uneven(a, b)).otherwise(even(a, b)), told)
