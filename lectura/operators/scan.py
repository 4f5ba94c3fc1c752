"""Lengths and areas in free text, by the longest window that reads.

A window begins at a number and may cross blanks on the guess that digits behind them belong to the number, or that a unit follows.
The distinct candidates of all texts are read once by the full grammars and joined back by a hash; neither a text nor its other
columns are carried along, so what is read, sorted or grouped grows with the distinct candidates, not with the rows. Where the widest window reads as nothing, the next narrower one counts, and what it leaves is the residue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import windows
from .read import Context, read

GRAMMARS = ("japanese_length", "traditional_area", "square_metres", "metric_idiom", "registered", "feet_inches", "number", "typo_corrected")
#: What reads a window: values and qualifiers, but neither ranges nor conversions.
READER = Context(only=GRAMMARS, ranges=False, conversions=False, compounds=False, fuzzy=True)
MEASURES = ("length", "area")


def scan(docs: DataFrame, column: str, dimensions: tuple[str, ...] = MEASURES, reader: Context = READER) -> DataFrame:
    """The rows of docs (without the column) with a row per match, in the order of clause and at:

    clause, at (which candidate of the clause), text (as written), char_start, char_end, start, end (in bytes of the text), hint
    (the dimension that a label before it stands for), reading, residue (what the widest window holds behind the text), code.
    A number without unit counts behind the label of a length, and is UNIT_ASSUMED; with a residue the code is TRAILING_INPUT.
    A null or empty text gives no rows. Columns of docs with one of these names are replaced.
    """
    names = ["clause", "at", "text", "char_start", "char_end", "start", "end", "hint", "reading", "residue", "code"]
    own = [c for c in docs.columns if c != column and c not in names]
    rest = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    found = docs.select(rest.alias("_own"), F.explode(windows(F.col(column))).alias("_w"))
    # what a candidate gives depends on its windows and its label alone: each distinct pair is settled once and joined back
    key = lambda ways, hint: F.sha2(F.to_json(F.struct(F.col(ways).alias("ways"), F.col(hint).alias("hint"))), 256).alias("_k")
    asked = found.select("_w.ways", "_w.hint").distinct()
    each = read(asked.select(key("ways", "hint"), "hint", F.posexplode("ways").alias("_i", "_way")), "_way", reader)
    hint = F.col("hint")
    measure = (F.col("reading.kind") == "quantity") & F.col("reading.dimension").isin(*[d for d in dimensions if d in MEASURES]) & (hint.isNull() | (hint == F.col("reading.dimension")))
    bare = (F.col("reading.kind") == "number") & (hint == "length") & F.lit("length" in dimensions)
    chosen = each.filter(measure | bare).groupBy("_k").agg(F.min(F.struct("_i", F.col("_way").alias("text"), "reading")).alias("_c"))
    # hashed are the distinct candidates, whatever a table's file size lets expect of the rows; those stream by, unsorted
    kept = found.withColumn("_k", key("_w.ways", "_w.hint")).join(chosen.hint("shuffle_hash"), "_k")
    widest, text, start = F.get(F.col("_w.ways"), F.lit(0)), F.col("_c.text"), F.col("_w.start")
    residue = F.nullif(F.trim(F.substring(widest, F.length(text) + 1, F.length(widest))), F.lit(""))
    code = F.when(residue.isNotNull(), "TRAILING_INPUT").when(F.col("_c.reading.kind") == "number", "UNIT_ASSUMED").otherwise(F.col("_c.reading.code"))
    return kept.select(
        *[F.col(f"_own.`{c}`") for c in own], "_w.clause", "_w.at", text.alias("text"), "_w.char_start", (F.col("_w.char_start") + F.length(text)).alias("char_end"),
        start.alias("start"), (start + F.octet_length(text)).alias("end"), F.col("_w.hint").alias("hint"), "_c.reading", residue.alias("residue"), code.alias("code"),
    )
