"""The reading: one struct type that every grammar returns, null where it doesn't apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

FIELDS = {"kind": "string", "value": "double", "unit": "string", "dimension": "string", "date": "string", "low": "double", "high": "double", "approximate": "boolean", "confidence": "double", "code": "string", "others": "array<double>", "timezone": "string", "dates": "array<string>", "suggestion": "string"}
DDL = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def reading(kind: str, applies: Column, **fields) -> Column:
    """A reading where applies holds; fields that aren't given are null."""
    values = {"kind": F.lit(kind), "approximate": F.lit(False)} | {k: _column(v) for k, v in fields.items()}
    return F.when(applies, F.struct(*[values[k].cast(t).alias(k) if k in values else F.expr(f"CAST(NULL AS {t}) AS {k}") for k, t in FIELDS.items()]))


def quantity(value: Column, unit, dimension, confidence: float, **fields) -> Column:
    return let(value, lambda v: reading("quantity", v.isNotNull(), value=v, unit=unit, dimension=dimension, confidence=confidence, **fields))
