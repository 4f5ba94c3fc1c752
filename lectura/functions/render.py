"""Readings as text: exact numbers, humanised values, field lists and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantities import SHAKU, TATAMI, TSUBO
from .text import let

UNWRITABLE = "unrepresentable"


def exact_number(value: Column) -> Column:
    """The shortest decimal that reads back as the value, never with an exponent; 0 for -0."""
    shapes = [F.format_string(f"%.{p}e", value) for p in (14, 15, 16)]
    short = F.coalesce(*[F.when(s.try_cast("double") == value, s) for s in shapes[:2]], shapes[2])
    digits = lambda s: F.regexp_replace(F.replace(F.regexp_extract(s, r"^-?([0-9.]+)e", 1), F.lit("."), F.lit("")), "0+$", "")
    power = lambda s: F.regexp_extract(s, r"e([+-][0-9]+)$", 1).cast("int")

    def plain(s: Column) -> Column:
        return let(
            F.struct(digits(s).alias("d"), power(s).alias("e")),
            lambda x: F.when(x["e"] < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -x["e"] - 1), x["d"]))
            .when(F.length(x["d"]) <= x["e"] + 1, F.rpad(x["d"], x["e"] + 1, F.lit("0")))
            .otherwise(F.concat(F.substring(x["d"], F.lit(1), x["e"] + 1), F.lit("."), F.substring(x["d"], x["e"] + 2, F.length(x["d"])))),
        )

    written = F.concat(F.when(value < 0, "-").otherwise(""), let(short, plain))
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(value.isNotNull(), F.when(~finite, UNWRITABLE).when(value == 0, "0").otherwise(written))


def rounded_number(value: Column) -> Column:
    """To six decimals, without trailing zeros."""
    near = F.when(F.abs(value) < 1e15, F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6).otherwise(value)
    return exact_number(F.when(F.isnan(value), value).otherwise(near))


def japanese_length(metres: Column, number: Column) -> Column:
    """In 尺 and 寸 where that is within a fiftieth of a 尺, else in metres; number is the metres as text."""
    total = metres / SHAKU
    shaku, sun = F.floor(total), F.floor((total - F.floor(total)) * 10 + 0.5)
    near = (shaku > 0) & (F.abs(total - (shaku + sun / 10)) < 0.02)
    some = F.when(sun == 0, "").otherwise(F.concat(sun.cast("string"), F.lit("寸")))
    return F.when(near, F.concat(shaku.cast("string"), F.lit("尺"), some, F.lit(" (approx.)"))).otherwise(F.concat(number, F.lit(" m")))


def japanese_area(area: Column, number: Column) -> Column:
    """In 帖, then in 坪, where that is within a fiftieth of one, else in square metres; number is those as text."""
    whole = lambda x: F.floor(x + 0.5)
    mats, tsubo = area / TATAMI, area / TSUBO
    told = lambda n, name: F.concat(whole(n).cast("string"), F.lit(f"{name} (approx.)"))
    return F.when(F.abs(mats - whole(mats)) < 0.02, told(mats, "帖")).when(F.abs(tsubo - whole(tsubo)) < 0.02, told(tsubo, "坪")).otherwise(F.concat(number, F.lit(" m2")))


def _value(value: Column, unit: Column, dimension: Column, japanese: Column | None = None) -> Column:
    """A quantity; with japanese it is told in Japanese where that holds."""
    def written(number: Column) -> Column:
        told = lambda text: F.concat(number, F.lit(text))
        celsius = (unit == "C") & (dimension == "temperature")
        out = (
            F.when(unit.isNull(), number)
            .when(dimension == "currency", F.concat(unit, F.lit(" "), number))
            .when((unit == "C") & (dimension == "charge"), told(" coulombs"))  # C alone would read as degrees
            .when(celsius, told(" °C"))
            .otherwise(F.concat(number, F.lit(" "), unit))
        )
        if japanese is None:
            return out
        return (
            F.when(japanese & (unit == "m"), japanese_length(value, number))
            .when(japanese & (unit == "m2"), japanese_area(value, number))
            .when(japanese & celsius, F.concat(F.lit("摂氏"), number, F.lit("度")))
            .otherwise(out)
        )

    return let(exact_number(value), written)


def humanize(reading: Column, locale: str | None = None) -> Column:
    """A reading as text for people. In Japanese both ends of a range take the traditional units, or neither does."""
    unit, dimension = reading["unit"], reading["dimension"]
    always = F.lit(True) if locale in ("ja", "ja-JP") else None
    one = _value(reading["value"], unit, dimension, always)
    both = None
    if always is not None:
        ends = [F.endswith(_value(reading[k], unit, dimension, always), F.lit("(approx.)")) for k in ("low", "high")]
        both = F.coalesce(~unit.isin("m", "m2") | (ends[0] == ends[1]), F.lit(True))
    pair = F.concat(_value(reading["low"], unit, dimension, both), F.lit(" to "), _value(reading["high"], unit, dimension, both))
    return (
        F.when(reading["kind"] == "quantity", F.coalesce(one, F.lit("unresolved")))
        .when(reading["kind"] == "number", F.coalesce(exact_number(reading["value"]), F.lit("unresolved")))
        .when(reading["kind"] == "date", F.coalesce(reading["date"], F.lit("unknown date")))
        .when(reading["kind"] == "range", F.coalesce(pair, F.lit("unresolved range")))
        .otherwise("unresolved")
    )


def describe(reading: Column) -> Column:
    """The reading as a struct of object, summary and an ordered list of (name, value), absent fields left out."""
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    flag = lambda c: F.when(c, "true").otherwise("false")
    is_range = reading["kind"] == "range"
    of_end = lambda end, k: F.when(is_range, reading[k]) if end else F.when(~is_range, reading[k])
    fields = [field("kind", reading["kind"]), field("value", exact_number(reading["value"])), field("unit", of_end(False, "unit")), field("dimension", of_end(False, "dimension")), field("date", reading["date"]), field("timezone", reading["timezone"])]
    fields += [field("approximate", flag(reading["approximate"])), field("confidence", rounded_number(reading["confidence"]))]
    for end, k in (("from", "low"), ("to", "high")):
        fields += [field(f"range.{end}.value", exact_number(reading[k])), field(f"range.{end}.unit", of_end(True, "unit")), field(f"range.{end}.dimension", of_end(True, "dimension"))]
    return F.struct(F.concat(F.lit("lectura."), reading["kind"]).alias("object"), humanize(reading).alias("summary"), F.filter(F.array(*fields), lambda f: f["value"].isNotNull()).alias("fields"))


def json_string(text: Column) -> Column:
    """The text as a JSON string; control characters beyond ASCII and DEL are escaped too."""
    out = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    escaped = out
    for code in [0x7F, *range(0x80, 0xA0)]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(text.isNotNull(), F.when(out.rlike("[\\x7f-\\x{9f}]"), escaped).otherwise(out))


def _object(*members: tuple[str, Column | None]) -> Column:
    """A JSON object of the members that aren't null, in this order; values are JSON already."""
    told = F.array_compact(F.array(*[F.concat(F.lit(f'"{name}":'), value) for name, value in members]))
    return F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}"))


def reading_json(reading: Column) -> Column:
    """What was read, without absent fields; a number that isn't finite is null."""
    number = lambda v: F.when(v.isNotNull(), F.when(F.isnan(v) | (F.abs(v) == float("inf")), "null").otherwise(exact_number(v)))
    is_range = reading["kind"] == "range"
    unit, dimension = json_string(reading["unit"]), json_string(reading["dimension"])
    end = lambda k: _object(("kind", F.lit('"quantity"')), ("value", number(reading[k])), ("unit", unit), ("dimension", dimension))
    ends = F.when(is_range, _object(("from", end("low")), ("to", end("high"))))
    alone = lambda c: F.when(~is_range, c)
    return _object(("kind", json_string(reading["kind"])), ("value", number(reading["value"])), ("unit", alone(unit)), ("dimension", alone(dimension)), ("date", json_string(reading["date"])), ("timezone", json_string(reading["timezone"])), ("range", ends))
