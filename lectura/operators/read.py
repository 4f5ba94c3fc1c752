"""Reading a text column: every distinct text once, by grammars in a fixed order; the first that reads or refuses settles it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, quantities, times
from ..functions.numbers import competing_numbers, number
from ..functions.readings import FIELDS, quantity, reading
from ..functions.text import let, normalized
from ..functions.units import unit_of
from ..sources.registry import aliases, units


@dataclass(frozen=True)
class Context:
    """What a caller decides; dates are read only against a reference date."""

    locale: str | None = None
    number_format: str = "auto"
    reference_date: str | None = None
    strictness: str = "forgiving"
    ranges: bool = True
    conversions: bool = True
    compounds: bool = True
    fuzzy: bool = True
    rates: tuple[tuple[str, str, float], ...] = ()
    dimensions: tuple[str, ...] = ()  # those that may come out; empty: all
    registry: tuple[str, ...] | None = None  # those whose units are known; None: all
    only: tuple[str, ...] | None = None  # grammars of single values to try, by name; None: all
    fuzzy_terms: tuple[tuple[str, float, float, str, str], ...] = field(default=())  # term, low, high, unit, dimension


QUALIFIER = r"(?i)^(?:approximately|approx\.?|around|roughly|about|約) ?(.+)$|^(.+?) ?(?:\(approx\.\)|approx\.|approximately)$"
UPPER_BOUND = r"(?i)^(?:less than|under|below|up to|at most|最大|上限|≤|<) ?(.+)$|^(.+?)(?:以下|未満|まで)$"


#: How the two sides of a range are written, the texts of the roles left and right.
ENDS = r"^(?:between (.+) and (.+)|from (.+) to (.+)|(.+?) ?[〜～~] ?(.+)|(.+?)(?: to | ?\.\. ?)(.+)|(.*?[0-9]) ?- ?([0-9].*))$"
AROUND = r"^(.+?) ?(?:±|\+/-|\+-) ?(.+)$"

# Words for temperatures and their ranges in degrees Celsius, where a column holds temperatures.
TEMPERATURES = ((("暑い",), 27.0, 35.0), (("暖か",), 20.0, 27.0), (("寒い",), 0.0, 10.0), (("hot",), 27.0, 35.0), (("warm",), 20.0, 27.0), (("cold",), 0.0, 10.0))


#: Fuzzy terms, or a caller's units, up to which they are broadcast.
BROADCAST_TERMS = 100_000


class Heads:
    """Collects texts to be read by one expensive expression, which then stands once, over an array column of all of them."""

    def __init__(self, column: str):
        self.column, self.texts = column, []

    def __call__(self, text: Column) -> Column:
        self.texts.append(text)
        return F.get(F.col(self.column), F.lit(len(self.texts) - 1))

    def all(self, reader) -> dict[str, Column]:
        """The array column of what reader makes of the texts, by its name; nothing if there are none."""
        if not self.texts:
            return {}
        return {self.column: F.transform(F.array(*[F.coalesce(t, F.lit("")) for t in self.texts]), reader)}


#: Built expressions that are kept, the latest ones.
KEPT = 64
_built: dict[tuple, object] = {}


def once(spark: SparkSession, *key, build):
    """What build gives, built once in an application: expressions that name columns only serve every frame that has these."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _built:
        while len(_built) >= KEPT:
            del _built[next(iter(_built))]
        _built[key] = build()
    return _built[key]


def parts(text: Column, ctx: Context) -> Column:
    """(role, text) of the text and of what stands around a range sign or behind a qualifier; a side without unit borrows the other's."""
    some = lambda pattern, *groups: F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])
    unit = lambda t: F.regexp_extract(t, r"^[0-9.,]+( *[^0-9.,\s].*)$", 1)
    lend = lambda t, other: F.when(t.rlike("^[0-9.,]+$"), F.concat(t, F.coalesce(unit(other), F.lit("")))).otherwise(t)
    left, right = some(ENDS, 1, 3, 5, 7, 9), some(ENDS, 2, 4, 6, 8, 10)
    centre, delta = some(AROUND, 1), some(AROUND, 2)
    roles = {"whole": text}
    if ctx.ranges:
        roles |= {"left": lend(left, right), "right": right, "centre": lend(centre, delta), "delta": lend(delta, centre), "top": some(UPPER_BOUND, 1, 2)}
    if ctx.fuzzy:
        roles |= {"inner": some(QUALIFIER, 1, 2)}
    return F.filter(F.array(*[F.struct(F.lit(k).alias("role"), v.alias("part")) for k, v in roles.items()]), lambda x: x["part"].isNotNull())


def single(text: Column, unit: Column, whole: Column, ctx: Context, num, formatted) -> Column:
    """One value, by grammars in their order. Compounds, cups and doubtful numbers count only where they are the whole text.

    Where units are read, 5m3 is one of them and no metres and centimetres.
    """
    head, tail = quantities.split_number_unit(text)
    none = reading("number", F.lit(False))
    reference = F.lit(ctx.reference_date).cast("date")
    order = {
        "slash_fraction": lambda: F.when(whole, times.slash_fraction(text, reference, ctx.locale, num)),
        "slash_date": lambda: F.when(whole, times.slash_date(text, ctx.locale)),
        "date": lambda: times.relative_date(text, reference),
        "japanese_length": lambda: quantities.japanese_length(text, num),
        "traditional_area": lambda: quantities.traditional_area(text, num),
        "square_metres": lambda: quantities.square_metres(text, num),
        "temperature": lambda: quantities.temperature(text, num),
        "compound": lambda: F.when(whole, quantities.compound(text, ctx.number_format)) if ctx.compounds else none,
        "metric_idiom": lambda: F.when(unit.isNull() | F.lit(ctx.only is not None and "registered" not in ctx.only), quantities.metric_idiom(text, num)),
        "registered": lambda: quantities.registered(formatted(head), unit),
        "zoned_clock": lambda: times.zoned_clock(text, reference),
        "clock": lambda: times.clock(text),
        "duration": lambda: times.duration(text),
        "feet_inches": lambda: quantities.feet_inches(text, num),
        "cups": lambda: F.when(whole, quantities.cups(text, ctx.locale, formatted)),
        "currency": lambda: money.currency(text, formatted),
        "ambiguous_number": lambda: F.when(whole, ambiguous_number(text, ctx)),
        "number": lambda: let(formatted(text), lambda n: reading("number", n.isNotNull(), value=n, confidence=0.99)),
        "typo_corrected": lambda: quantities.typo_corrected(formatted(head), F.when(unit.isNull(), tail), ctx.strictness, ctx.registry),
        "unsupported_zone": lambda: times.unsupported_zone(text),
    }
    return F.coalesce(*[grammar() for name, grammar in order.items() if ctx.only is None or name in ctx.only])


def combined(text: Column, of: dict[str, Column], ctx: Context, num, unit) -> Column:
    """The text's reading from those of its parts: qualifiers, fuzzy terms, dates, ranges, conversions, then the single value."""
    none = reading("number", F.lit(False))
    marked = lambda x: F.struct(*[{"approximate": F.lit(True), "confidence": x["confidence"] * 0.9, "code": F.lit("APPROXIMATION")}.get(k, x[k]).cast(t).alias(k) for k, t in FIELDS.items()])
    whole = of["whole"]
    ranges = F.coalesce(_tolerance(of["centre"], of["delta"]), _bound(of["top"]), _pair(of["left"], of["right"])) if ctx.ranges else none
    return F.coalesce(
        F.when(of["inner"].isNotNull(), marked(of["inner"])) if ctx.fuzzy else none,
        fuzzy(text, ctx, unit) if ctx.fuzzy else none,
        F.when(whole["kind"] == "date", whole),
        ranges,
        F.coalesce(quantities.convert(text, num, unit), money.exchange(text, list(ctx.rates), num)) if ctx.conversions else none,
        whole,
    )


def _tolerance(c: Column, d: Column) -> Column:
    return reading("range", c["unit"].eqNullSafe(d["unit"]) & c["value"].isNotNull() & d["value"].isNotNull(), low=c["value"] - d["value"], high=c["value"] + d["value"], unit=c["unit"], dimension=c["dimension"], confidence=0.93)


def _bound(x: Column) -> Column:
    return reading("range", F.coalesce((x["kind"] == "quantity") & (x["value"] >= 0), F.lit(False)), low=0.0, high=x["value"], unit=x["unit"], dimension=x["dimension"], confidence=0.86)


def _pair(a: Column, b: Column) -> Column:
    """Both ends have to agree on kind and unit. The written order stays; a falling range is marked."""
    agree = F.coalesce((a["kind"] == b["kind"]) & a["unit"].eqNullSafe(b["unit"]) & a["value"].isNotNull() & b["value"].isNotNull(), F.lit(False))
    return reading("range", agree, low=a["value"], high=b["value"], unit=a["unit"], dimension=a["dimension"], confidence=0.94, code=F.when(a["value"] > b["value"], "AMBIGUOUS_NUMBER"))


def fuzzy(text: Column, ctx: Context, unit) -> Column:
    """A few of a unit is two to four; further terms come from the context."""
    few = unit(F.regexp_extract(text, r"(?i)^a few (.+)$", 1))
    out = reading("range", few.isNotNull(), low=2.0 * few["factor"], high=4.0 * few["factor"], unit=few["canonical"], dimension=few["dimension"], approximate=True, confidence=0.648, code="APPROXIMATION")
    if "temperature" in ctx.dimensions:
        for words, low, high in TEMPERATURES:
            warm = F.lower(text).rlike("|".join(words))
            out = F.coalesce(out, reading("range", warm, low=low, high=high, unit="C", dimension="temperature", approximate=True, confidence=0.612, code="APPROXIMATION"))
    if ctx.fuzzy_terms:
        p = F.col("_profile")
        out = F.coalesce(out, reading("range", p.isNotNull(), low=p["low"], high=p["high"], unit=p["unit"], dimension=p["dimension"], approximate=True, confidence=0.612, code="APPROXIMATION"))
    return out


def with_profile(texts: DataFrame, text: str, ctx: Context) -> DataFrame:
    """Adds _profile, the context's fuzzy term that a text is: a join, so that a plan doesn't grow with the terms."""
    first: dict[str, tuple] = {}
    for term, *rest in ctx.fuzzy_terms:
        first.setdefault(term.lower(), (term.lower(), *map(float, rest[:2]), *rest[2:]))
    terms = texts.sparkSession.createDataFrame(list(first.values()), "term string, low double, high double, unit string, dimension string")
    keyed = terms.select(F.col("term").alias("_term"), F.struct("low", "high", "unit", "dimension").alias("_profile"))
    return texts.join(F.broadcast(keyed) if len(first) <= BROADCAST_TERMS else keyed, F.lower(text) == F.col("_term"), "left").drop("_term")


def ambiguous_number(text: Column, ctx: Context) -> Column:
    if ctx.number_format != "auto":
        return reading("number", F.lit(False))
    best, other = competing_numbers(text)
    return reading("number", best.isNotNull(), value=best, confidence=0.64, code="AMBIGUOUS_NUMBER", others=F.array(other))


def singles(rows: DataFrame, text: str, whole: Column, ctx: Context, custom: DataFrame | None = None) -> DataFrame:
    """rows with `_single`, the single value that the column `text` holds."""

    def build():
        num, formatted = Heads("_numbers"), Heads("_formatted")
        read_ = single(F.col(text), F.col("u"), whole, ctx, num, formatted)
        return read_, num.all(lambda h: number(h)) | formatted.all(lambda h: number(h, ctx.number_format)), quantities.split_number_unit(F.col(text))[1]

    read_, heads, token = once(rows.sparkSession, "single", text, str(whole), ctx, build=build)
    keyed = with_unit(rows.withColumn("_token", token), "_token", ctx, custom)
    return keyed.withColumns(heads).withColumn("_single", read_).drop("_token", "u", "_numbers", "_formatted")


def with_unit(texts: DataFrame, token: str, ctx: Context, custom: DataFrame | None = None) -> DataFrame:
    """Adds u, the unit that the column `token` names: joins with the table of spellings, exact ones first; broadcast while the
    caller's units are few."""
    few = custom is None or custom.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    near = F.broadcast if few else (lambda df: df)
    table = aliases(texts.sparkSession, custom, list(ctx.registry) if ctx.registry is not None else None)
    exact = near(table.filter("exact").select(F.col("alias").alias("_a"), F.col("u").alias("_exact")))
    any_case = near(table.filter("not exact").select(F.col("alias").alias("_b"), F.col("u").alias("_any")))
    low = F.translate(F.col(token), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = texts.join(exact, F.col(token) == F.col("_a"), "left").join(any_case, low == F.col("_b"), "left")
    return joined.withColumn("u", F.coalesce("_exact", "_any")).drop("_a", "_b", "_exact", "_any")


def read(df: DataFrame, column: str, ctx: Context = Context(), custom: DataFrame | None = None, judge_dimensions: bool = True) -> DataFrame:
    """df with a struct column `reading`: what each text says, a code where it is doubtful, and null fields where it says nothing.

    Distinct texts are read once and joined back by their MD5, so long texts are no keys; a null text reads as null. A blank text
    has the code EMPTY, an unreadable one NO_VALUE, one outside the context's dimensions REJECTED_BY_POLICY. A column of df that
    is named reading is replaced; no other name clashes.
    """
    given = df.select(F.col(column).alias("_text")).filter(F.col(column).isNotNull()).distinct()
    texts = given.select(F.md5("_text").alias("_key"), normalized(F.col("_text")).alias("_norm"))
    nothing = reading("none", F.lit(True), code=F.when(F.col("_norm") == "", "EMPTY").otherwise("NO_VALUE"))
    if not (ctx.ranges or ctx.fuzzy or ctx.conversions):
        told = singles(texts, "_norm", F.lit(True), ctx, custom).withColumn("reading", F.coalesce("_single", nothing))
    else:
        spark = df.sparkSession
        rows = texts.select("_key", F.explode(once(spark, "parts", ctx, build=lambda: parts(F.col("_norm"), ctx))).alias("_p")).select("_key", "_p.role", "_p.part")
        each = singles(rows, "part", F.col("role") == "whole", ctx, custom)
        roles = ["whole", "left", "right", "centre", "delta", "top", "inner"]
        of_role = [F.max_by(F.when(F.col("role") == r, F.col("_single")), F.col("role") == r).alias(f"_{r}") for r in roles]
        whole = each.groupBy("_key").agg(F.max(F.when(F.col("role") == "whole", F.col("part"))).alias("_norm"), *of_role)
        if ctx.fuzzy and ctx.fuzzy_terms:
            whole = with_profile(whole, "_norm", ctx)

        def build():
            num, unit = Heads("_numbers"), Heads("_units")
            first = F.coalesce(combined(F.col("_norm"), {r: F.col(f"_{r}") for r in roles}, ctx, num, unit), nothing)
            return first, num.all(lambda h: number(h)) | unit.all(lambda t: unit_of(t))

        first, heads = once(spark, "combined", ctx, build=build)
        told = whole.withColumns(heads).withColumn("reading", first)
    told = told.select("_key", judged(F.col("reading"), ctx, judge_dimensions).alias("reading"))
    return joined_back(df.drop("reading") if column != "reading" else df, column, told)


def joined_back(rest: DataFrame, column: str, told: DataFrame) -> DataFrame:
    """rest with what told says of each text, by told's `_key`. The hash is a column of its own, so that a text that isn't asked
    for further on stays out of the shuffle."""
    key = "_key"
    while key in rest.columns:
        key = "_" + key
    return rest.withColumn(key, F.md5(rest[column])).join(told.withColumnRenamed("_key", key), key, "left").drop(key)


def judged(r: Column, ctx: Context, judge_dimensions: bool = True) -> Column:
    """Policies over a reading: no infinities, only the dimensions asked for, and nothing approximate under strict."""
    wild = F.coalesce(F.abs(r["value"]) == float("inf"), F.lit(False)) | F.coalesce(F.isnan(r["value"]), F.lit(False))
    out = F.when(wild, reading("none", F.lit(True), code="NO_VALUE")).otherwise(r)
    if ctx.dimensions and judge_dimensions:
        out = F.when(r["dimension"].isNotNull() & ~r["dimension"].isin(*ctx.dimensions), reading("refused", F.lit(True), code="REJECTED_BY_POLICY")).otherwise(out)
    if ctx.strictness == "strict":
        out = F.when(r["approximate"], reading("refused", F.lit(True), code="APPROXIMATION")).otherwise(out)
    return out


def suggestions(texts: DataFrame, column: str) -> DataFrame:
    """texts with `suggestion`: the unit meant by a misspelt token, by edit distance among spellings of the same first letter.

    One edit for tokens of up to five letters, two for longer ones; the nearest wins, then the first in the registry. The
    table of spellings is small and broadcast; known spellings get none.
    """
    token = lambda c: F.lower(F.regexp_extract(c, r"([A-Za-z]+)$", 1))
    words = texts.select(token(F.col(column)).alias("_w")).filter("length(_w) between 2 and 32").distinct()
    spelled = F.broadcast(units(texts.sparkSession).withColumn("_alias", F.explode("aliases")).filter(F.col("_alias").rlike("^[A-Za-z]+$")).select("pos", "unit", F.lower("_alias").alias("_alias")))
    unknown = words.join(spelled, F.col("_w") == F.col("_alias"), "left_anti")
    limit = F.when(F.length("_w") <= 5, 1).otherwise(2)
    near = unknown.join(spelled, (F.substring("_w", 1, 1) == F.substring("_alias", 1, 1)) & (F.abs(F.length("_w") - F.length("_alias")) <= limit) & F.levenshtein("_w", "_alias", 2).between(1, limit))
    best = near.groupBy("_w").agg(F.min_by("unit", F.struct(F.levenshtein("_w", "_alias"), "pos")).alias("suggestion"))
    rest = texts.drop("suggestion")
    return rest.join(best, token(rest[column]) == best["_w"], "left").drop(best["_w"])
