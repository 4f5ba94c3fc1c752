"""Acceptance and ranking of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, severity, rank, recoverable.
ISSUES = (
    ("EMPTY", "error", 100, False), ("NO_VALUE", "error", 100, False), ("TIMEZONE_UNSUPPORTED", "error", 90, True),
    ("REJECTED_BY_POLICY", "error", 90, True), ("COMPOUND_OVERFLOW", "error", 90, True), ("TRAILING_INPUT", "error", 90, True),
    ("UNKNOWN_UNIT", "error", 80, True), ("TYPO_CORRECTED", "warning", 65, True), ("AMBIGUOUS_DATE", "warning", 55, True),
    ("AMBIGUOUS_NUMBER", "warning", 55, True), ("AMBIGUOUS_UNIT", "warning", 55, True), ("AMBIGUOUS_CURRENCY", "warning", 55, True),
    ("UNIT_ASSUMED", "info", 40, True), ("APPROXIMATION", "warning", 30, True),
)


def accepts(reading: Column, strictness: str = "forgiving") -> Column:
    """Something was read and nothing refused; unless forgiving, nothing doubtful or approximate either."""
    read = reading.isNotNull() & ~reading["kind"].isin("none", "refused")
    return F.coalesce(read if strictness == "forgiving" else read & reading["code"].isNull() & ~reading["approximate"], F.lit(False))


def issues(df: DataFrame, reading: str = "reading") -> DataFrame:
    """Rows with a finding, with its severity, rank and whether a caller can recover: a broadcast join with fourteen rows."""
    table = df.sparkSession.createDataFrame(ISSUES, "code string, severity string, rank int, recoverable boolean")
    return df.withColumn("code", F.col(f"{reading}.code")).join(F.broadcast(table), "code")


def canonicalize(fields: DataFrame, ctx) -> DataFrame:
    """A batch of (field, text) with ok, the canonical value and unit, and a message where it isn't ok."""
    from .read import read

    r = F.col("reading")
    done = read(fields, "text", ctx).withColumn("ok", accepts(r, ctx.strictness))
    return done.select("field", "text", "ok", F.when(F.col("ok"), r["value"]).alias("value"), F.when(F.col("ok"), r["unit"]).alias("unit"), F.when(~F.col("ok"), F.coalesce(r["code"], F.lit("NO_VALUE"))).alias("message"))
