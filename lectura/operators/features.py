"""Which grammars a column's texts can need at all: one pass over the column, then plans with those grammars only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, quantities
from ..functions.text import normalized
from .read import AROUND, ENDS, QUALIFIER, UPPER_BOUND, Context, parts, with_unit

_CURRENCY = "|".join([money.CODES.replace(" ", "|"), *(rf"\Q{w}\E" for w in (*money.PREFIXES, *money.SUFFIXES, *money.MINOR)), r"\$", "dollar", "cent"])
#: What a text has to hold for a grammar to read it; grammars that aren't here can read any text.
HOLDS = {
    "slash_fraction": "/",
    "slash_date": "/",
    "japanese_length": "[間尺寸]",
    "traditional_area": "[帖畳坪]",
    "square_metres": r"㎡|m2|m\^2|平米",
    "temperature": "(?i)[cfk]$|度$",
    "compound": r"\S \S+ +\S+ +\S",
    "metric_idiom": "m[0-9]",
    "zoned_clock": r"(?i)(?:[0-9]:|[ap]\.?m|noon|midnight|時).* \S+$",
    "clock": r"(?i)[0-9]:|[0-9] ?[ap]\.?m|時|noon|midnight",
    "unsupported_zone": "/",
    "duration": "(?i)^p|[0-9][wdhms]|hour|hr|時間",
    "feet_inches": "(?i)feet|foot|ft|['′]",
    "cups": "(?i)cup",
    "currency": f"(?i){_CURRENCY}",
    "ambiguous_number": "[.,][0-9]{3}$",
}


def features(text: Column, unit: Column, ctx: Context) -> dict[str, Column]:
    """Whether each grammar may hold for a text whose unit is known."""
    tail = quantities.split_number_unit(text)[1]
    found = {name: text.rlike(pattern) for name, pattern in HOLDS.items()}
    return found | {"date": F.lit(ctx.reference_date is not None), "registered": unit.isNotNull(), "typo_corrected": unit.isNull() & (tail != ""), "number": F.lit(True)}


def narrowed(df: DataFrame, column: str, ctx: Context = Context(), custom: DataFrame | None = None) -> Context:
    """ctx with only the grammars, ranges, qualifiers and conversions that some text of the column may need: reading with it gives
    the same readings. Runs one pass over the distinct texts, which pays where a column has few kinds of values."""
    texts = df.select(normalized(F.col(column)).alias("_norm")).filter(F.col("_norm").isNotNull()).distinct()
    rows = texts.select("_norm", F.explode(parts(F.col("_norm"), ctx)).alias("_p")).select("_norm", F.col("_p.part").alias("part"))
    keyed = with_unit(rows.withColumn("_token", quantities.split_number_unit(F.col("part"))[1]), "_token", ctx, custom)
    of_text = {
        "ranges": F.col("_norm").rlike("|".join((ENDS, AROUND, UPPER_BOUND))),
        "fuzzy": F.col("_norm").rlike(QUALIFIER + "|(?i)^a few ") if not ctx.fuzzy_terms and "temperature" not in ctx.dimensions else F.lit(True),
        "conversions": F.col("_norm").rlike("(?i) (?:to|in|into|as) "),
    }
    may = features(F.col("part"), F.col("u"), ctx)
    seen = keyed.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (may | of_text).items()]).first().asDict()
    only = tuple(n for n in may if seen[n] and (ctx.only is None or n in ctx.only))
    return replace(ctx, only=only, **{k: getattr(ctx, k) and seen[k] for k in of_text})
