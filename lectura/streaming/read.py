"""Readings of single values over a stream: a stateless map, without the distinct step of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.readings import reading
from ..functions.text import normalized
from ..operators.read import Context, judged, singles


def read_stream(stream: DataFrame, column: str, ctx: Context = Context()) -> DataFrame:
    """stream with the column `reading` for single values; watermarks and windows are the caller's.

    Ranges, qualifiers, fuzzy terms and conversions are read from parts of a text, which a map doesn't bring together: under a
    context that has them a stream reads single values only.
    """
    rows = stream.drop("reading").select(F.struct("*").alias("_row"), normalized(F.col(column)).alias("_norm"), F.col(column).isNotNull().alias("_there"))
    nothing = reading("none", F.col("_there"), code=F.when(F.col("_norm") == "", "EMPTY").otherwise("NO_VALUE"))
    return singles(rows, "_norm", F.lit(True), ctx).select("_row.*", judged(F.coalesce("_single", nothing), ctx).alias("reading"))
