"""Unit lookup inside expressions, for grammars that look up more than one unit of a text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.registry import ROWS
from .text import ascii_lower, trimmed

_TYPE = "map<string,struct<unit:string,canonical:string,dimension:string,factor:double,approximate:boolean>>"


def _table(any_case: bool) -> Column:
    found: dict[str, dict] = {}
    for _, unit, canonical, dimension, factor, approximate, names in ROWS:
        for a in names:
            if not any_case or (a.isascii() and a == a.lower()):
                found.setdefault(a, {"unit": unit, "canonical": canonical, "dimension": dimension, "factor": factor, "approximate": approximate})
    return F.from_json(F.lit(json.dumps(found, ensure_ascii=False)), _TYPE)


def unit_of(token: Column) -> Column:
    """The unit a spelling names: exactly, or in any case if the spelling has no capitals."""
    t = trimmed(token)
    return F.coalesce(F.try_element_at(_table(False), t), F.try_element_at(_table(True), ascii_lower(t)))


_SPELLED = "array<struct<alias:string,bytes:int,unit:string,canonical:string,dimension:string,factor:double,approximate:boolean>>"


def _spelled(ascii_: bool, registry: tuple[str, ...] | None) -> list[dict]:
    """Spellings without blanks, in the registry's order."""
    fits = lambda a: a.isascii() == ascii_ and not any(c.isspace() for c in a)
    return [
        {"alias": a.lower(), "bytes": len(a.encode()), "unit": unit, "canonical": canonical, "dimension": dimension, "factor": factor, "approximate": approximate}
        for _, unit, canonical, dimension, factor, approximate, names in ROWS
        if registry is None or dimension in registry
        for a in names
        if fits(a)
    ]


def meant(token: Column, registry: tuple[str, ...] | None = None) -> Column:
    """The unit that a misspelt token means: the nearest spelling, the registry's first among equals.

    Null for the spelling of a unit that the registry leaves out; that isn't misspelt. Spellings it has are the caller's to skip.

    ASCII spellings share the token's first letter and are one edit away, two if the token has over five bytes. Others are one
    edit away, two if they have over two characters, and only correct tokens of two to eight characters with a letter beyond ASCII.
    """
    letters: dict[str, list[dict]] = {}
    for row in _spelled(True, registry):
        letters.setdefault(row["alias"][0], []).append(row)
    table = F.from_json(F.lit(json.dumps(letters, ensure_ascii=False)), f"map<string,{_SPELLED}>")
    others = F.from_json(F.lit(json.dumps(_spelled(False, registry), ensure_ascii=False)), _SPELLED)
    t = ascii_lower(trimmed(token))
    size, beyond = F.octet_length(t), F.octet_length(t) - F.length(t)
    limit = F.when(size <= 5, 1).otherwise(2)
    # a letter beyond ASCII counts as its bytes
    near = lambda spelled, distance, within: F.array_min(F.filter(F.transform(spelled, lambda r, i: F.struct(distance(r["alias"]).alias("d"), i.alias("i"), r.alias("r"), F.length(r["alias"]).alias("n"))), within))["r"]
    plain = near(
        F.filter(F.try_element_at(table, F.substring(t, 1, 1)), lambda r: F.abs(r["bytes"] - size) <= limit),
        lambda a: F.levenshtein(a, t) + beyond,
        lambda x: x["d"].between(1, limit),
    )
    n = F.length(t)
    wide = near(
        F.filter(others, lambda r: F.abs(F.length(r["alias"]) - n) <= 2),
        lambda a: F.levenshtein(a, t),
        lambda x: x["d"].between(1, F.when(x["n"] <= 2, 1).otherwise(2)),
    )
    unknown = F.lit(True) if registry is None else unit_of(token).isNull()
    return F.when(unknown & (t != ""), F.coalesce(F.when(size <= 32, plain), F.when((beyond > 0) & n.between(2, 8), wide)))
