"""Completions of what someone types: words that a prefix can become, and readings that a number can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import number
from ..functions.readings import quantity
from ..functions.text import ascii_lower, normalized, trimmed
from ..sources.registry import ROWS, units
from .read import Context, read

# Words beside the registry's spellings, with the unit or currency that they name and its dimension.
TRADITIONAL = (
    ("shaku", "shaku", "length"), ("尺", "shaku", "length"), ("sun", "sun", "length"), ("寸", "sun", "length"), ("ken", "ken", "length"), ("間", "ken", "length"),
    ("tsubo", "tsubo", "area"), ("坪", "tsubo", "area"), ("tatami", "tatami", "area"), ("帖", "tatami", "area"), ("畳", "tatami", "area"),
    ("celsius", "C", "temperature"), ("°C", "C", "temperature"), ("℃", "C", "temperature"), ("fahrenheit", "F", "temperature"), ("°F", "F", "temperature"),
    ("℉", "F", "temperature"), ("kelvin", "K", "temperature"), ("摂氏", "C", "temperature"), ("華氏", "F", "temperature"),
)
DATES = (
    "today", "tomorrow", "yesterday", "next monday", "next tuesday", "next wednesday", "next thursday", "next friday", "next saturday", "next sunday", "this friday", "last friday",
    "mañana", "demain", "amanhã", "明天", "今日", "明日", "昨日", "来週月曜日", "来週火曜日", "来週水曜日", "来週木曜日", "来週金曜日", "来週土曜日", "来週日曜日", "下周五",
)
TIMES = ("noon", "midnight", "午後3時", "午前9時")
CURRENCIES = (
    ("USD", "USD"), ("EUR", "EUR"), ("GBP", "GBP"), ("JPY", "JPY"), ("dollar", "USD"), ("dollars", "USD"), ("bucks", "USD"), ("euro", "EUR"), ("euros", "EUR"),
    ("pound", "GBP"), ("pounds", "GBP"), ("quid", "GBP"), ("yen", "JPY"), ("円", "JPY"), ("pence", "GBP"), ("cents", "USD"),
)
#: Completions of a prefix or text, at most; units that a bare number is offered with.
MOST, UNITS = 24, 12


#: Rows of custom units up to which the words are broadcast; with more of them they are joined by a shuffle.
CUSTOM_ROWS = 20_000


def vocabulary(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """value, canonical, kind, dimension of every word that can complete: some 600 rows, and the spellings of custom units."""
    each = units(spark) if custom is None else units(spark).unionByName(custom.select(F.lit(0).alias("pos"), "unit", "canonical", "dimension", "factor", "approximate", "aliases"))
    spelled = each.select(F.explode("aliases").alias("value"), F.col("unit").alias("canonical"), F.lit("unit").alias("kind"), "dimension")
    rows = [(v, c, "unit", d) for v, c, d in TRADITIONAL] + [(v, None, "date", None) for v in DATES] + [(v, None, "time", "time") for v in TIMES] + [(v, c, "currency", "currency") for v, c in CURRENCIES]
    return spelled.unionByName(spark.createDataFrame(rows, spelled.schema)).distinct()


def complete(prefixes: DataFrame, column: str, dimensions: tuple[str, ...] = (), expect: str | None = None, custom: DataFrame | None = None) -> DataFrame:
    """Rows of prefixes with value, canonical, kind, dimension, score and rank: the words that the last word of a text can become.

    A word of the prefix itself scores 1, a longer one less the longer it is. dimensions and expect (date, number, quantity,
    range) leave out what a field can't hold. custom are units of the caller's, in the columns of units(). Every beginning of a
    word is a key of its own, so prefixes meet words by equality; words are broadcast while the custom ones are few.
    """
    spark = prefixes.sparkSession
    words = vocabulary(spark, custom)
    if dimensions:
        words = words.filter(F.col("dimension").isin(*dimensions))
    if expect in ("date", "number", "quantity"):
        words = words.filter(F.col("kind").isin({"date": ["date"], "number": [], "quantity": ["unit", "time", "currency"]}[expect]))
    low = ascii_lower(trimmed(F.col("value")))
    words = words.select(F.struct("value", "canonical", "kind", "dimension").alias("_word"), low.alias("_low"))
    begun = words.select("_word", "_low", F.explode(F.transform(F.sequence(F.lit(1), F.length("_low")), lambda n: F.substring("_low", F.lit(1), n))).alias("_begun"))
    few = custom is None or custom.limit(CUSTOM_ROWS + 1).count() <= CUSTOM_ROWS
    last = ascii_lower(F.regexp_extract(normalized(F.col("_typed")), r"(\S+)$", 1))
    typed = prefixes.select(F.col(column).alias("_typed")).distinct().withColumn("_prefix", last)
    near = typed.join(F.broadcast(begun) if few else begun, F.col("_prefix") == F.col("_begun"))
    size = F.octet_length("_prefix")
    score = F.when(F.col("_low") == F.col("_prefix"), 1.0).otherwise(0.6 + 0.4 * size / F.greatest(F.octet_length("_low"), size))
    order = Window.partitionBy("_typed").orderBy(F.desc("score"), "value", "kind")
    told = near.select("_typed", "_word.*", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST)
    return prefixes.join(told, prefixes[column] == told["_typed"]).drop("_typed")


def complete_readings(texts: DataFrame, column: str, ctx: Context = Context()) -> DataFrame:
    """Rows of texts with offer, reading, score, reason and rank: what the text reads as, and for a bare number that number of the
    first units of the registry that the context's dimensions allow."""
    typed = texts.select(F.col(column).alias("_typed")).filter(F.col(column).isNotNull()).distinct()
    told = read(typed, "_typed", ctx).filter(~F.col("reading.kind").isin("none", "refused"))
    offer = lambda text, value, score, reason, pos: F.struct(text.alias("offer"), value.alias("reading"), score.alias("score"), F.lit(reason).alias("reason"), pos.alias("pos"))
    sure = F.coalesce(F.col("reading.confidence"), F.lit(0.0))
    best = F.array(offer(F.col("_typed"), F.col("reading"), sure, "best", F.lit(-1)))
    others = F.transform(F.coalesce(F.col("reading.others"), F.array().cast("array<double>")), lambda v, i: offer(F.col("_typed"), F.col("reading").withField("value", v), sure, "alternative", i))
    first = [row for row in ROWS if not ctx.dimensions or row[3] in ctx.dimensions][:UNITS]

    def fanned(n: Column) -> Column:
        offers = []
        for pos, unit, canonical, dimension, factor, approximate, _ in first:
            text = F.concat(trimmed(F.col("_typed")), F.lit(f" {unit}"))
            offers.append(F.when(F.abs(n * factor) < float("inf"), offer(text, quantity(n * factor, canonical, dimension, 0.45, approximate=approximate), F.lit(0.45), "unit_fanout", F.lit(pos))))
        return F.array_compact(F.array(*offers))

    bare = typed.withColumn("_number", number(normalized(F.col("_typed")), ctx.number_format)).filter(F.col("_number").isNotNull())
    offered = told.select("_typed", F.explode(F.concat(best, others)).alias("o")).unionByName(bare.select("_typed", F.explode(fanned(F.col("_number"))).alias("o")))
    order = Window.partitionBy("_typed").orderBy(F.desc("score"), "offer", "pos")
    # a reading that an earlier offer has too isn't offered again
    same = Window.partitionBy("_typed", *[F.col(f"reading.{k}") for k in ("kind", "value", "unit", "date", "low", "high")]).orderBy(F.desc("score"), "pos")
    each = offered.select("_typed", "o.*").withColumn("_again", F.row_number().over(same)).filter("_again = 1").drop("_again")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST).drop("pos")
    return texts.join(ranked, texts[column] == ranked["_typed"]).drop("_typed")
