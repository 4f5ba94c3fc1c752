"""Lengths and areas inside free text, as rows whose reading says all: the scan by windows, with its codes in the reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import MEASURES, scan


def extract(docs: DataFrame, column: str, dimensions: tuple[str, ...] = MEASURES) -> DataFrame:
    """scan's rows without its code: the code is the reading's, and a number taken for a length has itself as the other reading,
    in millimetres."""
    found = scan(docs, column, dimensions)
    bare = (F.col("reading.kind") == "number") & (F.col("hint") == "length")
    others = F.when(bare, F.array("reading.value")).otherwise(F.col("reading.others"))
    return found.withColumn("reading", F.col("reading").withField("code", F.col("code")).withField("others", others)).drop("code")
