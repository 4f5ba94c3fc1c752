"""Registered queries: texts composed from typed columns of the tables, read back; the SQL recomputes them from the columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.render import describe, humanize
from .operators.complete import complete, complete_readings
from .operators.extract import extract
from .operators.features import narrowed
from .operators.policy import accepts, canonicalize, issues
from .operators.read import Context, read, suggestions
from .operators.views import message, summary_json

QUERIES, ORACLE_SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(*grammars: str, **settings) -> Context:
    """A context that tries few grammars, for columns whose kind is known."""
    return Context(**{"only": grammars, "ranges": False, "conversions": False, "fuzzy": False} | settings)


UNIT = narrow("registered")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def texted(spark, sf_dir, name, key, text: Column, ctx=Context(), custom=None) -> DataFrame:
    return read(table(spark, sf_dir, name).select(F.col(key).alias("id"), text.alias("text")), "text", ctx, custom)


def told(df: DataFrame, *fields: str, digits: int = 6) -> DataFrame:
    """id and fields of the reading, numbers rounded so that the order of additions doesn't show."""
    r = F.col("reading")
    return df.select("id", *[(F.round(r[f], digits) if f in ("value", "low", "high") else r[f]).alias(f) for f in fields])


def s(column: str) -> Column:
    return F.col(column).cast("string")


def values(name: str, table_name: str, key: str, text: Callable[[], Column], sql_value: str, unit: str, dimension: str, ctx=Context(), where: str = "true") -> None:
    """A query whose readings are one value per row, of one unit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return told(texted(spark, sf_dir, table_name, key, text(), ctx), "kind", "value", "unit", "dimension")

    run.__name__ = name
    QUERIES[name] = run
    literal = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    kind = "quantity" if unit else "number"
    ORACLE_SQL[name] = f"SELECT {key} AS id, '{kind}' AS kind, round({sql_value}, 6) AS value, {literal(unit)} AS unit, {literal(dimension)} AS dimension FROM {table_name}"


values("registered_length", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" cm")), "p_size * 0.01", "m", "length", UNIT)
values("fullwidth_digits", "part", "p_partkey", lambda: F.concat(F.translate(s("p_size"), "0123456789", "０１２３４５６７８９"), F.lit("ｍｍ")), "p_size * 0.001", "m", "length", UNIT)
values("spanish_mass", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" kilogramos")), "p_size * 1.0", "kg", "mass", UNIT)
values("upper_case_unit", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" KG")), "p_size * 1.0", "kg", "mass", UNIT)
values("speed", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" mph")), "p_size * (1609.344 / 3600.0)", "m/s", "speed", UNIT)
values("data_size", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" MB")), "p_size * 1000000.0", "B", "data", UNIT)
values("temperature_f", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" °F")), "(p_size - 32.0) * 5.0 / 9.0", "C", "temperature", narrow("temperature"))
values("temperature_k", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" K")), "p_size - 273.15", "C", "temperature", narrow("temperature"))
values("square_metres", "part", "p_partkey", lambda: F.concat(F.lit("延床"), s("p_size"), F.lit("㎡")), "p_size * 1.0", "m2", "area", narrow("square_metres"))
values("tatami", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit("畳半")), "(p_size + 0.5) * 1.62", "m2", "area", narrow("traditional_area"))
values("tsubo", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit("坪")), "p_size * (400.0 / 121.0)", "m2", "area", narrow("traditional_area"))
values("japanese_length", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit("尺3寸")), "p_size * (10.0 / 33.0) + 3 * (1.0 / 33.0)", "m", "length", narrow("japanese_length"))
values("metric_idiom", "part", "p_partkey", lambda: F.concat(F.lit("1m"), s("p_size")), "1 + p_size * 0.01", "m", "length", narrow("metric_idiom"))
values("feet_inches", "lineitem", "l_orderkey", lambda: F.concat(s("l_linenumber"), F.lit("ft "), s("l_linenumber")), "l_linenumber * 0.3048 + l_linenumber * 0.0254", "m", "length", narrow("feet_inches"))
values("compound", "lineitem", "l_orderkey", lambda: F.concat(F.lit("3 yd "), (F.col("l_linenumber") % 3).cast("string"), F.lit(" ft")), "3 * 0.9144 + (l_linenumber % 3) * 0.3048", "m", "length", narrow("compound", "registered"))
values("conversion", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" in to cm")), "p_size * 0.0254 / 0.01", "cm", "length", narrow("registered", conversions=True))
values("currency_prefix", "part", "p_partkey", lambda: F.concat(F.lit("EUR "), s("p_size")), "p_size * 1.0", "EUR", "currency", narrow("currency"))
values("currency_suffix", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit("円")), "p_size * 1.0", "JPY", "currency", narrow("currency"))
values("currency_minor", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit(" pence")), "p_size / 100.0", "GBP", "currency", narrow("currency"))
values("exchange", "part", "p_partkey", lambda: F.concat(F.lit("USD "), s("p_size"), F.lit(" to JPY")), "p_size * 150.5", "JPY", "currency", narrow("currency", conversions=True, rates=(("USD", "JPY", 150.5),)))
values("duration_iso", "events", "event_id", lambda: F.concat(F.lit("PT"), F.hour("ts").cast("string"), F.lit("H"), F.minute("ts").cast("string"), F.lit("M")), "hour(ts) * 3600.0 + minute(ts) * 60.0", "s", "time", narrow("duration"))
values("duration_compact", "events", "event_id", lambda: F.concat(F.hour("ts").cast("string"), F.lit("h"), F.minute("ts").cast("string")), "hour(ts) * 3600.0 + minute(ts) * 60.0", "s", "time", narrow("duration"))
values("clock_24h", "events", "event_id", lambda: F.date_format("ts", "HH:mm:ss"), "hour(ts) * 3600.0 + minute(ts) * 60.0 + second(ts)", "s", "time", narrow("clock"))
values("clock_12h", "events", "event_id", lambda: F.date_format("ts", "h:mm a"), "hour(ts) * 3600.0 + minute(ts) * 60.0", "s", "time", narrow("clock"))
values("japanese_clock", "events", "event_id", lambda: F.concat(F.hour("ts").cast("string"), F.lit("時"), F.minute("ts").cast("string"), F.lit("分")), "hour(ts) * 3600.0 + minute(ts) * 60.0", "s", "time", narrow("clock"))
values("zoned_clock", "events", "event_id", lambda: F.concat(F.date_format("ts", "HH:mm"), F.lit(" EST")), "(hour(ts) * 3600.0 + minute(ts) * 60.0 + 18000.0) % 86400.0", "s", "time", narrow("zoned_clock", "clock"))
values("grouped_number", "orders", "o_orderkey", lambda: F.format_number("o_totalprice", 2), "round(o_totalprice, 2)", None, None, narrow("ambiguous_number", "number"))
values("comma_decimal", "orders", "o_orderkey", lambda: F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), "round(o_totalprice, 2)", None, None, narrow("number", number_format="comma_decimal"))
values("myriad_number", "part", "p_partkey", lambda: F.concat(s("p_size"), F.lit("億")), "p_size * 100000000.0", None, None, narrow("number"))
values("number_words", "lineitem", "l_orderkey", lambda: F.concat(F.element_at(F.array(*map(F.lit, "one two three four five six seven".split())), F.col("l_linenumber")), F.lit(" hundred and twenty-five")), "l_linenumber * 100.0 + 25", None, None, narrow("number"))
values("cjk_number", "lineitem", "l_orderkey", lambda: F.concat(F.element_at(F.array(*map(F.lit, "二三四五六七八")), F.col("l_linenumber")), F.lit("百二十三")), "(l_linenumber + 1) * 100.0 + 23", None, None, narrow("number"))


@query("SELECT 'm' AS unit, 'length' AS dimension, count(*) AS n, round(sum(p_size * 0.01), 4) AS total FROM part")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written as text, read and summed by unit."""
    read_ = texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit(" cm")), UNIT)
    return read_.groupBy("reading.unit", "reading.dimension").agg(F.count("*").alias("n"), F.round(F.sum("reading.value"), 4).alias("total"))


@query(
    "SELECT p_partkey AS id, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN 0.0254 WHEN 2 THEN 0.3048 WHEN 3 THEN 0.9144 ELSE 1609.344 END, 6) AS value, 'm' AS unit FROM part"
)
def alias_family(spark, sf_dir):
    names = F.array(*map(F.lit, ("centimetres", "inches", "feet", "yards", "miles")))
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit(" "), F.get(names, (F.col("p_partkey") % 5).cast("int"))), UNIT), "value", "unit")


@query("SELECT p_partkey AS id, p_size * 1000.0 + 125 AS value, (p_size * 1000.0 + 125) / 1000.0 AS other, 'AMBIGUOUS_NUMBER' AS code FROM part")
def ambiguous_number(spark, sf_dir):
    df = texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit(",125")), narrow("ambiguous_number", "number"))
    return df.select("id", F.col("reading.value").alias("value"), F.col("reading.others")[0].alias("other"), F.col("reading.code").alias("code"))


@query("SELECT p_partkey AS id, p_size * 1.0 AS value, 'USD' AS unit, 'AMBIGUOUS_CURRENCY' AS code, 2 AS others FROM part")
def dollar_ambiguous(spark, sf_dir):
    df = texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("$"), s("p_size")), narrow("currency"))
    return told(df, "value", "unit", "code").join(df.select("id", F.size("reading.others").alias("others")), "id")


@query("SELECT p_partkey AS id, round(p_size * 0.2365882365, 6) AS value, 'L' AS unit, 'AMBIGUOUS_UNIT' AS code FROM part")
def cups(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit(" cups")), narrow("cups", locale="en-US")), "value", "unit", "code")


@query("SELECT l_orderkey AS id, l_linenumber AS line, 'refused' AS kind, 'COMPOUND_OVERFLOW' AS code FROM lineitem")
def compound_overflow(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("1 yd "), (F.col("l_linenumber") + 3).cast("string"), F.lit(" ft")).alias("text"))
    return read(df, "text", narrow("compound", "registered")).select("id", "line", "reading.kind", "reading.code")


@query("SELECT p_partkey AS id, 'range' AS kind, round(p_size * 0.001, 6) AS low, round((p_size + 5) * 0.001, 6) AS high, 'm' AS unit, NULL::VARCHAR AS code FROM part")
def range_hyphen(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" mm")), narrow("registered", "number", ranges=True)), "kind", "low", "high", "unit", "code")


@query("SELECT p_partkey AS id, round((p_size + 5) * 1.0, 6) AS low, round(p_size * 1.0, 6) AS high, 'kg' AS unit, 'AMBIGUOUS_NUMBER' AS code FROM part")
def descending_range(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("between "), (F.col("p_size") + 5).cast("string"), F.lit(" and "), s("p_size"), F.lit(" kg")), narrow("registered", "number", ranges=True)), "low", "high", "unit", "code")


@query("SELECT p_partkey AS id, round(p_size * 0.001 - 0.0005, 6) AS low, round(p_size * 0.001 + 0.0005, 6) AS high, 'm' AS unit FROM part")
def tolerance(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), F.lit(" ± 0.5 mm")), narrow("registered", "number", ranges=True)), "low", "high", "unit")


@query("SELECT p_partkey AS id, 0.0 AS low, p_size * 60.0 AS high, 's' AS unit FROM part")
def upper_bound(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("under "), s("p_size"), F.lit(" minutes")), narrow("registered", "number", ranges=True)), "low", "high", "unit")


@query("SELECT p_partkey AS id, p_size * 1.0 AS value, 'kg' AS unit, true AS approximate, 'APPROXIMATION' AS code FROM part")
def qualified(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("about "), s("p_size"), F.lit("kg")), narrow("registered", fuzzy=True)), "value", "unit", "approximate", "code")


@query("SELECT p_partkey AS id, 2 * f AS low, 4 * f AS high, unit FROM part JOIN (VALUES (0, 60.0::DOUBLE, 's'), (1, 3600.0, 's'), (2, 1.0, 'kg')) AS v(i, f, unit) ON p_partkey % 3 = v.i")
def a_few(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ("a few minutes", "A few hours", "a few kilograms"))), (F.col("p_partkey") % 3).cast("int"))
    return told(texted(spark, sf_dir, "part", "p_partkey", text, narrow("registered", fuzzy=True)), "low", "high", "unit")


@query("SELECT o_orderkey AS id, 'date' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def iso_date(spark, sf_dir):
    return told(texted(spark, sf_dir, "orders", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), narrow("date", reference_date="2026-07-19")), "kind", "date")


@query("SELECT p_partkey AS id, strftime(DATE '2026-07-19' + p_size::INT, '%Y-%m-%d') AS date FROM part")
def relative_days(spark, sf_dir):
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("in "), s("p_size"), F.lit(" days")), narrow("date", reference_date="2026-07-19")), "date")


@query("SELECT p_partkey AS id, strftime(DATE '2026-07-20' + ((p_partkey + 6) % 7)::INT, '%Y-%m-%d') AS date FROM part")
def next_weekday(spark, sf_dir):
    days = F.array(*map(F.lit, ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")))
    return told(texted(spark, sf_dir, "part", "p_partkey", F.concat(F.lit("next "), F.get(days, (F.col("p_partkey") % 7).cast("int"))), narrow("date", reference_date="2026-07-19")), "date")


@query(
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'AMBIGUOUS_DATE' END AS code FROM orders"
)
def slash_date(spark, sf_dir):
    return told(texted(spark, sf_dir, "orders", "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy"), narrow("slash_date")), "date", "code")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'kg' ELSE NULL END AS suggestion FROM part")
def suggested_units(spark, sf_dir):
    words = F.array(*map(F.lit, ("meterz", "kilogrem", "metres")))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(s("p_size"), F.lit(" "), F.get(words, (F.col("p_partkey") % 3).cast("int"))).alias("text"))
    return suggestions(df, "text").select("id", "suggestion")


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AS ok, CASE WHEN p_partkey % 2 = 1 THEN 'REJECTED_BY_POLICY' END AS code FROM part")
def policy_refusal(spark, sf_dir):
    unit = F.when(F.col("p_partkey") % 2 == 0, " cm").otherwise(" kg")
    df = texted(spark, sf_dir, "part", "p_partkey", F.concat(s("p_size"), unit), narrow("registered", dimensions=("length", "area")))
    return df.select("id", accepts(F.col("reading")).alias("ok"), F.col("reading.code").alias("code"))


@query("SELECT code, severity, rank, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'AMBIGUOUS_CURRENCY' WHEN 1 THEN 'NO_VALUE' WHEN 2 THEN 'EMPTY' ELSE 'APPROXIMATION' END AS code, CASE p_partkey % 4 WHEN 0 THEN 'warning' WHEN 3 THEN 'warning' ELSE 'error' END AS severity, CASE p_partkey % 4 WHEN 0 THEN 55 WHEN 3 THEN 30 ELSE 100 END AS rank FROM part) GROUP BY ALL")
def finding_ranks(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 4 == 0, "$5").when(F.col("p_partkey") % 4 == 1, "no such thing").when(F.col("p_partkey") % 4 == 2, "  ").otherwise("約3m")
    return issues(texted(spark, sf_dir, "part", "p_partkey", text, narrow("registered", "currency", "number", fuzzy=True))).groupBy("code", "severity", "rank").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS field, p_partkey % 2 = 0 AS ok, CASE WHEN p_partkey % 2 = 0 THEN round(p_size * 0.3048, 6) END AS value, CASE WHEN p_partkey % 2 = 1 THEN 'AMBIGUOUS_NUMBER' END AS message FROM part")
def canonical_batch(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(s("p_size"), F.lit(" feet"))).otherwise(F.concat(s("p_size"), F.lit(",125")))
    done = canonicalize(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field"), text.alias("text")), narrow("registered", "ambiguous_number", "number", strictness="confirm"))
    return done.select("field", "ok", F.round("value", 6).alias("value"), "message")


@query("SELECT p_partkey AS id, 0 AS clause, p_size || 'mm' AS text, round(p_size * 0.001, 6) AS value FROM part UNION ALL SELECT p_partkey, 2, '30 m2', 30.0 FROM part")
def editor_extract(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("幅"), s("p_size"), F.lit("mm、予算5kg、beamA105mm 30 m2")).alias("note"))
    return extract(df, "note").select("id", "clause", "text", F.round("reading.value", 6).alias("value"))


@query(
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'range' WHEN 3 THEN 'number' ELSE 'quantity' END AS kind, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 0.01, 6) WHEN 2 THEN p_size * 1.0 WHEN 3 THEN p_size * 10000.0 END AS value FROM part"
)
def every_grammar(spark, sf_dir):
    """A column of mixed kinds, of which nothing is known before: of all grammars those that it can need."""
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(s("p_size"), F.lit("cm"))).when(kind == 1, F.concat(F.lit("from 1 to "), (F.col("p_size") + 1).cast("string"), F.lit(" kg"))).when(kind == 2, F.concat(F.lit("EUR "), s("p_size"))).otherwise(F.concat(s("p_size"), F.lit("万")))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return told(read(df, "text", narrowed(df, "text")), "kind", "value")


@query("SELECT doc_id AS id, CASE WHEN trim(text) = '' THEN 'EMPTY' ELSE 'NO_VALUE' END AS code FROM documents WHERE text IS NOT NULL")
def hostile_documents(spark, sf_dir):
    """Whole documents are no quantities, and each says so."""
    df = texted(spark, sf_dir, "documents", "doc_id", F.col("text"), narrow("registered", "temperature", "currency", "number")).filter("text is not null")
    return df.select("id", "reading.code")


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def cases(name: str, rows: list[tuple], columns: str, run, number: bool = False) -> None:
    """A query over part, whose rows take the texts in turn by their key; the other columns are what comes of a text.

    With number, the text is p_size and what stands here, and the columns value and low and high are times p_size.
    """

    def over(spark: SparkSession, sf_dir: str) -> DataFrame:
        tail = F.get(F.array(*[F.lit(r[0]) for r in rows]), (F.col("p_partkey") % len(rows)).cast("int"))
        text = F.concat(s("p_size"), tail) if number else tail
        return run(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))

    over.__name__ = name
    QUERIES[name] = over
    names = columns.replace(" ", "").split(",")
    told = ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(rows))
    of = {n: f"v.{n}" for n in names} | ({"text": "p_size || v.text", "value": "round(p_size * v.value, 6)"} if number else {})
    ORACLE_SQL[name] = f"SELECT p_partkey AS id, {', '.join(f'{of[n]} AS {n}' for n in names)} FROM part JOIN (VALUES {told}) AS v(i, {', '.join(names)}) ON p_partkey % {len(rows)} = v.i"


def fields_of(ctx: Context, *fields: str):
    field = lambda f: F.round(f"reading.{f}", 6) if f in ("value", "low", "high") else F.col(f"reading.{f}")
    return lambda df: read(df, "text", ctx).select("id", "text", *[field(f).alias(f) for f in fields])


DAY = "2026-07-19"
#: Numbers of one to fifty in words and in CJK numerals.
TENS = ["", "", "twenty", "thirty", "forty", "fifty"]
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()


def in_words(n: int) -> str:
    return SMALL[n] if n < 20 else TENS[n // 10] + (f"-{SMALL[n % 10]}" if n % 10 else "")


def in_cjk(n: int) -> str:
    digits = "〇一二三四五六七八九"
    return ("" if n < 20 else digits[n // 10]) + ("十" if n >= 10 else "") + (digits[n % 10] if n % 10 else "")


def spelled(spell) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n in range(1, 51) for x in (n, spell(n))]), F.col("p_size"))


def by_size(name: str, text, sql: str, ctx: Context, *fields: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return told(texted(spark, sf_dir, "part", "p_partkey", text(), ctx), *fields)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql


by_size("worded_head", lambda: F.concat(spelled(in_words), F.lit(" kg")), "SELECT p_partkey AS id, 'quantity' AS kind, p_size * 1.0::DOUBLE AS value, 'kg' AS unit FROM part", UNIT, "kind", "value", "unit")
by_size("cjk_head", lambda: F.concat(spelled(in_cjk), F.lit("キログラム")), "SELECT p_partkey AS id, 'quantity' AS kind, p_size * 1.0::DOUBLE AS value, 'kg' AS unit FROM part", UNIT, "kind", "value", "unit")
by_size("spaced_group", lambda: F.format_string("%d %03d,5 m", F.col("p_partkey") % 900 + 1, F.col("p_size")), "SELECT p_partkey AS id, 'quantity' AS kind, ((p_partkey % 900 + 1) * 1000 + p_size + 0.5)::DOUBLE AS value, 'm' AS unit FROM part", UNIT, "kind", "value", "unit")
by_size("typo_unit", lambda: F.concat(s("p_size"), F.lit(" metrs")), "SELECT p_partkey AS id, 'quantity' AS kind, p_size * 1.0::DOUBLE AS value, 'm' AS unit, 'TYPO_CORRECTED' AS code, 'm' AS suggestion FROM part", narrow("registered", "typo_corrected"), "kind", "value", "unit", "code", "suggestion")
by_size("typo_refused", lambda: F.concat(s("p_size"), F.lit(" minites")), "SELECT p_partkey AS id, 'refused' AS kind, NULL::DOUBLE AS value, 'TYPO_CORRECTED' AS code, 'min' AS suggestion FROM part", narrow("registered", "typo_corrected", strictness="confirm"), "kind", "value", "code", "suggestion")
by_size(
    "slash_fraction", lambda: F.concat((F.col("p_size") % 12 + 1).cast("string"), F.lit("/"), (F.col("p_partkey") % 28 + 1).cast("string")),
    "SELECT p_partkey AS id, 'number' AS kind, round((p_size % 12 + 1)::DOUBLE / (p_partkey % 28 + 1), 6) AS value, 'AMBIGUOUS_DATE' AS code FROM part", narrow("slash_fraction", reference_date=DAY), "kind", "value", "code",
)
by_size("region_clock", lambda: F.concat((F.col("p_size") % 24).cast("string"), F.lit(":30 Asia/Tokyo")), "SELECT p_partkey AS id, 'quantity' AS kind, (((p_size % 24) * 3600 + 1800 - 32400 + 86400) % 86400)::DOUBLE AS value, 'UTC' AS timezone FROM part", narrow("zoned_clock", reference_date=DAY), "kind", "value", "timezone")
by_size("unresolved_zone", lambda: F.concat((F.col("p_size") % 24).cast("string"), F.lit(":30 Mars/Olympus")), "SELECT p_partkey AS id, 'refused' AS kind, 'TIMEZONE_UNSUPPORTED' AS code FROM part", narrow("zoned_clock", "unsupported_zone", reference_date=DAY), "kind", "code")

cases(
    "dates_in_languages",
    [(t, "date", d) for t, d in (
        ("mañana", "2026-07-20"), ("pasado mañana", "2026-07-21"), ("demain", "2026-07-20"), ("amanhã", "2026-07-20"), ("明天", "2026-07-20"), ("后天", "2026-07-21"), ("明後日", "2026-07-21"), ("一昨日", "2026-07-17"), ("昨日", "2026-07-18"),
        ("vendredi prochain", "2026-07-24"), ("lundi prochain", "2026-07-20"), ("sexta-feira que vem", "2026-07-24"), ("domingo que vem", "2026-07-26"), ("来週月曜日", "2026-07-20"), ("今週金曜日", "2026-07-24"), ("先週日曜日", "2026-07-12"), ("下周五", "2026-07-24"),
        ("next wed", "2026-07-22"), ("this sunday", "2026-07-19"), ("last tues", "2026-07-14"), ("in 45 days", "2026-09-02"), ("200 days ago", "2025-12-31"), ("3日後", "2026-07-22"), ("2日前", "2026-07-17"),
    )] + [("next year", "none", None), ("prochain", "none", None)],
    "text, kind, date", fields_of(narrow("date", reference_date=DAY), "kind", "date"),
)
cases(
    "misspelt_units",
    [(" metrs", 1.0, "m"), (" kilogrmos", 1.0, "kg"), (" quilometors", 1000.0, "m"), (" kilomètres", 1000.0, "m"), (" meterrs", 1.0, "m"), (" kilomters", 1000.0, "m"), (" litrs", 1.0, "L"), (" pouunds", 0.45359237, "kg"), (" onces", 0.028349523125, "kg"), (" minites", 60.0, "s"), (" heurs", 3600.0, "s"), (" metrez", 1.0, "m"), ("平目", 1.0, "m2"), (" zzzzz", None, None), (" €€", None, None)],
    "text, value, unit", fields_of(narrow("registered", "typo_corrected"), "value", "unit"), number=True,
)
cases(
    "fuzzy_temperature", [("warm", "range", 20.0, 27.0), ("really COLD", "range", 0.0, 10.0), ("暑いです", "range", 27.0, 35.0), ("mild", "none", None, None)],
    "text, kind, low, high", fields_of(narrow("number", fuzzy=True, dimensions=("temperature",)), "kind", "low", "high"),
)
cases("duration_phrases", [("an hour and a half", 5400.0), ("one hour and a half", 5400.0), ("an hour", 3600.0), ("two hours", 7200.0), ("90 min", 5400.0)], "text, value", fields_of(narrow("registered", "duration"), "value"))


@query("SELECT p_partkey AS id, regexp_replace((p_size * 0.0254::DOUBLE)::VARCHAR, '\\.0$', '') || ' m' AS told, 'lectura.quantity' AS object, 6 AS n_fields FROM part")
def humanized(spark, sf_dir):
    df = read(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(s("p_size"), F.lit(" in")).alias("text")), "text", UNIT)
    view = describe(F.col("reading"))
    return df.select("id", humanize(F.col("reading")).alias("told"), view["object"].alias("object"), F.size(view["fields"]).alias("n_fields"))


cases(
    "humanized_japanese", [("1.6060606060606062 m", "5尺3寸 (approx.)"), ("9.72 m2", "6帖 (approx.)"), ("9.917355371900827 m2", "3坪 (approx.)"), ("0.1 m", "0.1 m"), ("20 kg", "20 kg"), ("1e5 m", "unresolved")],
    "text, told", lambda df: read(df, "text", UNIT).select("id", "text", humanize(F.col("reading"), "ja").alias("told")),
)
cases(
    "summary_json",
    [
        ("5 kg", '{"ok":true,"input":"5 kg","best":{"kind":"quantity","value":5,"unit":"kg","dimension":"mass"},"issues":[]}'),
        ("0.1 mm", '{"ok":true,"input":"0.1 mm","best":{"kind":"quantity","value":0.0001,"unit":"m","dimension":"length"},"issues":[]}'),
        ('a "b"\\', '{"ok":false,"input":"a \\"b\\"\\\\","best":null,"issues":[{"code":"NO_VALUE","severity":"error","rank":100,"ref_text":"a \\"b\\"\\\\"}]}'),
        ("", '{"ok":false,"input":"","best":null,"issues":[{"code":"EMPTY","severity":"error","rank":100,"ref_text":""}]}'),
    ],
    "text, json", lambda df: read(df, "text", UNIT).select("id", "text", summary_json(F.col("text"), F.col("reading")).alias("json")),
)
cases(
    "repair_messages",
    [("5 kg", None), ("no", "[NO_VALUE] width: no supported reading matched at `no`."), ("7 minites", "[TYPO_CORRECTED] width: the unit's spelling was corrected at `7 minites`. Did you mean `min`?".replace("'", "''"))],
    "text, message", lambda df: read(df, "text", narrow("registered", "typo_corrected", strictness="strict")).select("id", "text", message(F.lit("width"), F.col("text"), F.col("reading"), "strict").alias("message")),
)
@query(
    "SELECT p_partkey AS id, p_size || v.typed AS text, v.value AS value, v.kind AS kind, round(0.6 + CASE WHEN a = b THEN 0.4 ELSE 0.4 * a / b END, 6)::DOUBLE AS score, 1 AS rank "
    "FROM part JOIN (VALUES (0, ' tat', 'tatami', 'unit', 3, 6), (1, ' NOO', 'noon', 'time', 3, 4), (2, ' 来週木', '来週木曜日', 'date', 9, 15)) AS v(i, typed, value, kind, a, b) ON p_partkey % 4 = v.i"
)
def completions(spark, sf_dir):
    typed = F.get(F.array(*map(F.lit, (" tat", " NOO", " 来週木", " qx"))), (F.col("p_partkey") % 4).cast("int"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(s("p_size"), typed).alias("text"))
    return complete(df, "text").select("id", "text", "value", "kind", F.round("score", 6).alias("score"), "rank")


@query(
    "WITH w AS (SELECT p_partkey AS id, lower(split_part(p_type, ' ', 1)) AS word, p_size FROM part) "
    "SELECT id, word AS value, 'custom ' || word AS canonical, 0.6 + 0.4 * 3 / strlen(word)::DOUBLE AS score FROM w WHERE strlen(word) > 3"
)
def custom_completions(spark, sf_dir):
    """Words of the parts' types as custom units, each completed from its first three letters in capitals."""
    word = F.lower(F.split("p_type", " ")[0])
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), word.alias("word"))
    custom = parts.select("word").distinct().select(F.col("word").alias("unit"), F.lit("m").alias("canonical"), F.lit("length").alias("dimension"), F.lit(1.0).alias("factor"), F.lit(False).alias("approximate"), F.array("word").alias("aliases"))
    typed = parts.select("id", "word", F.upper(F.substring("word", 1, 3)).alias("text"))
    found = complete(typed, "text", custom=custom).filter("value = word and canonical = word and kind = 'unit' and length(word) > 3")
    return found.select("id", "value", F.concat(F.lit("custom "), "canonical").alias("canonical"), "score")


@query("SELECT p_partkey AS id, u.offer_unit AS unit, round(p_size * u.factor, 6) AS value FROM part, (VALUES ('m2', 1.0), ('ft2', 0.09290304), ('acre', 4046.8564224), ('ha', 10000.0)) AS u(offer_unit, factor) UNION ALL SELECT p_partkey, 'best', p_size * 1.0 FROM part")
def completed_readings(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s("p_size").alias("text"))
    told_ = complete_readings(df, "text", narrow("number", dimensions=("area",)))
    return told_.select("id", F.when(F.col("reason") == "best", "best").otherwise(F.element_at(F.split("offer", " "), 2)).alias("unit"), F.round("reading.value", 6).alias("value"))


@query(
    "SELECT p_partkey AS id, '幅' || p_size || 'mm' IS NOT NULL AS told, p_size || 'mm' AS text, 1 AS char_start, 3::BIGINT AS start, (3 + length(p_size::VARCHAR) + 2)::BIGINT AS \"end\", 'length' AS hint, NULL::VARCHAR AS code, round(p_size * 0.001, 6) AS value FROM part "
    "UNION ALL SELECT p_partkey, true, '3640', length(p_size::VARCHAR) + 6, (length(p_size::VARCHAR) + 14)::BIGINT, (length(p_size::VARCHAR) + 18)::BIGINT, 'length', 'UNIT_ASSUMED', 3640.0 FROM part"
)
def editor_places(spark, sf_dir):
    """Matches with their places in characters and bytes, and a number that only its label makes a length."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("幅"), s("p_size"), F.lit("mm、高さ3640, beam12 7")).alias("note"))
    return extract(df, "note").select("id", F.lit(True).alias("told"), "text", "char_start", "start", "end", "hint", "reading.code", F.round("reading.value", 6).alias("value"))
