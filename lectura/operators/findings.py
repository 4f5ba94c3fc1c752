"""All that a text can mean: the best reading, competing ones, and ranked findings with their places in the original text.

A text whose number can be read in two ways becomes two texts, one as it is and one with the number written in the other way; both
are read by the same grammars, so that a competing reading has the grammar's own arithmetic. Everything else is derived within
the row, from the two readings and from the places of their parts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.offsets import original_place
from ..functions.numbers import locale_number
from ..functions.quantities import feet_inches, metric_idiom, split_number_unit
from ..functions.readings import DDL, FIELDS, quantity, reading
from ..functions.text import ascii_lower, let, normalized
from ..sources.registry import ROWS
from .policy import ISSUES
from .read import ENDS, Context, joined_back, once, read

#: A number with one separator before three digits, apart from other digits and separators.
DOUBTFUL = r"(?<![0-9.,])(?!0{1,3}[.,]000(?![0-9.,]))[0-9]{1,3}[.,][0-9]{3}(?![0-9.,])"
AROUND_DOUBT = rf"(?s)^(.*?)({DOUBTFUL})(.*)$"
# How much less likely a competing reading is, and the confidences of other readings of what is written.
COMPETING, OTHER_NUMBER, MILLIMETRES, OTHER_CUP = 0.875, 0.56, 0.41, 0.6
OTHER_CURRENCIES = {"dollar": (("CAD", 0.61), ("AUD", 0.59)), "cent": (("EUR", 0.58),)}
FINDING = "struct<kind:string,code:string,severity:string,rank:int,recoverable:boolean,reason:string,ref_text:string,start:bigint,end:bigint,candidates:int>"
PARSED = f"struct<best:{DDL},alternatives:array<{DDL}>,findings:array<{FINDING}>,accepted:boolean>"
#: What a finding says; of a refused dimension and of closed compounds below.
REASONS = {
    "EMPTY": "the text is empty",
    "NO_VALUE": "nothing that is written here can be read",
    "TIMEZONE_UNSUPPORTED": "the time zone can't be resolved",
    "COMPOUND_OVERFLOW": "a part reaches the unit above it",
    "TYPO_CORRECTED": "the unit's spelling was corrected",
    "AMBIGUOUS_DATE": "day and month can stand in either order",
    "AMBIGUOUS_NUMBER": "the separator can group digits or begin the decimals",
    "AMBIGUOUS_UNIT": "the unit has several sizes",
    "AMBIGUOUS_CURRENCY": "several currencies are written like this",
    "UNIT_ASSUMED": "a number without unit can be a length in millimetres",
    "APPROXIMATION": "the value is approximate",
}
FALLING = "the ends of the range fall; their order was kept"
CLOSED = "written together this is a unit of the registry and a compound; the unit was read"
CLOSED_PROMOTED = "written together this is a unit of the registry and a compound; the unit's dimension isn't expected, so the compound was read"
CLOSED_REFUSED = "written together this is a unit of the registry and a compound; the unit's dimension isn't expected, and neither was read"


def _of(values: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), code)


def scaled(r: Column, factor: float) -> Column:
    """A reading with less confidence."""
    return F.struct(*[(r[k] * factor if k == "confidence" else r[k]).cast(t).alias(k) for k, t in FIELDS.items()])


def group(text: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])


def tried(ctx: Context, *grammars: str) -> bool:
    """Whether the context reads any of these; what can't come up needs no expression."""
    return ctx.only is None or any(g in ctx.only for g in grammars)


def competing(norm: Column, best: Column, other: Column, closed: Column, ctx: Context) -> Column:
    """The other readings of the text, likeliest first; closed: what it says as a closed compound, if it is one of another reading."""
    number, is_ = best["kind"] == "number", lambda code: F.coalesce(best["code"] == code, F.lit(False))
    same = (other["kind"] == "quantity") & (best["kind"] == "quantity") & other["unit"].eqNullSafe(best["unit"]) & other["dimension"].eqNullSafe(best["dimension"]) & (other["value"] != best["value"])
    cents = norm.rlike("(?i)cents?$")
    currency = lambda which: [F.when(is_("AMBIGUOUS_CURRENCY") & (cents if which == "cent" else ~cents), quantity(best["value"], u, "currency", c)) for u, c in OTHER_CURRENCIES[which]]
    cup = lambda i: F.when(is_("AMBIGUOUS_UNIT"), quantity(F.get(best["others"], F.lit(i)), "L", "volume", OTHER_CUP))
    found = [
        F.when(is_("AMBIGUOUS_NUMBER") & number, reading("number", F.size(best["others"]) > 0, value=F.get(best["others"], F.lit(0)), confidence=OTHER_NUMBER)),
        F.when(F.coalesce(same, F.lit(False)), scaled(other, COMPETING)),
    ]
    if tried(ctx, "currency"):
        found += [*currency("dollar"), *currency("cent")]
    if tried(ctx, "cups"):
        found += [cup(0), cup(1)]
    if tried(ctx, "slash_date"):
        second = times.slash_dates(norm, ctx.locale)[1]
        found.append(F.when(is_("AMBIGUOUS_DATE") & (best["kind"] == "date"), reading("date", second.isNotNull(), date=second, confidence=0.93)))
    if "length" in ctx.dimensions:
        found.append(F.when(number, quantity(best["value"], "mm", "length", MILLIMETRES)))
    out = F.array_compact(F.array(*found, F.when(closed.isNotNull(), scaled(closed, COMPETING))))
    if tried(ctx, "slash_fraction"):
        dates = F.transform(best["dates"], lambda d: reading("date", d.isNotNull(), date=d, confidence=0.5))
        out = F.concat(out, F.coalesce(dates, F.array().cast(f"array<{DDL}>")))
    return out


def closed_compound(norm: Column, best: Column, ctx: Context) -> Column:
    """What a text without blanks says as metres and centimetres, or as feet and inches, where a unit was read instead."""
    if not tried(ctx, "metric_idiom", "feet_inches"):
        return F.lit(None).cast(DDL)
    low = ascii_lower(norm)
    inches = F.when(low.rlike(r"(?:feet|foot|ft|'|′)[0-9.,]"), feet_inches(low, locale_number))
    differs = lambda c: ~(c["value"].eqNullSafe(best["value"]) & c["unit"].eqNullSafe(best["unit"]))
    return F.when(~norm.rlike(r"\s") & (best["kind"] == "quantity"), let(F.coalesce(metric_idiom(low, locale_number), inches), lambda c: F.when(differs(c), c)))


def found(original: Column, norm: Column, best: Column, others: Column, closed: Column, refused: Column, promoted: Column, ctx: Context) -> Column:
    """The findings, by rank, then by the text they are about."""
    at = lambda fragment, after: let(F.position(fragment, norm, after + 1) - 1, lambda n: F.struct(n.alias("a"), (n + F.length(fragment)).alias("b")))
    whole = F.struct(F.lit(0).alias("a"), F.length(norm).alias("b"))
    zero = F.lit(0)

    def finding(applies: Column, kind: Column | str, code: Column | str, where: Column, reason: Column | None = None, candidates: Column | None = None) -> Column:
        parts = {"kind": kind, "code": code, "reason": reason, "candidates": candidates}
        types = {"candidates": "int"}
        fields = [(v if isinstance(v, Column) else F.lit(v)).cast(types.get(k, "string")).alias(k) for k, v in parts.items()]
        return F.when(F.coalesce(applies, F.lit(False)), F.struct(*fields, where["a"].cast("int").alias("a"), where["b"].cast("int").alias("b")))

    def placed(f: Column) -> Column:
        """What was found, with its place in the original and what its code stands for."""
        about = _of({row[0]: i for i, row in enumerate(ISSUES)}, f["code"])
        known = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rank"), F.lit(c).alias("recoverable")) for _, s, n, c in ISSUES])
        told = lambda p, k: F.struct(f["kind"].alias("kind"), f["code"].alias("code"), k["severity"].alias("severity"), k["rank"].alias("rank"), k["recoverable"].alias("recoverable"), F.coalesce(f["reason"], _of(REASONS, f["code"])).alias("reason"), p["text"].alias("ref_text"), p["start"].alias("start"), p["end"].alias("end"), f["candidates"].alias("candidates"))
        return let(original_place(original, f["a"], f["b"]), lambda p: let(F.get(known, about), lambda k: told(p, k)))

    code, kind = best["code"], best["kind"]
    strict = F.lit(ctx.strictness == "strict")
    two = F.lit(2)
    unit_word = F.trim(split_number_unit(norm)[1])
    left, right = group(norm, ENDS, 1, 3, 5, 7, 9), group(norm, ENDS, 2, 4, 6, 8, 10)
    is_range = kind == "range"
    auto = F.lit(ctx.number_format == "auto")
    left_at = let(left, lambda x: at(x, zero)["a"])
    # the right end is looked for behind the left one, as both can be written alike
    right_at = let(left_at + F.length(left), lambda n: at(right, n)["a"])
    doubt_in = lambda end, start: F.struct((start + F.length(F.regexp_extract(end, AROUND_DOUBT, 1))).alias("a"), (start + F.length(F.regexp_extract(end, AROUND_DOUBT, 1)) + F.length(F.regexp_extract(end, AROUND_DOUBT, 2))).alias("b"))
    doubtful = lambda end: end.rlike(DOUBTFUL) & ~F.regexp_extract(end, AROUND_DOUBT, 3).rlike(DOUBTFUL)
    competes = F.exists(others, lambda o: (o["kind"] == "quantity") & o["unit"].eqNullSafe(best["unit"]) & (o["value"] != best["value"])) & doubtful(norm)
    sign = F.coalesce(group(norm, r"(?i)(\$|dollars?$|cents?$)", 1), norm)
    qualifier = F.coalesce(group(norm, r"(?i)^(approximately|approx\.?|around|roughly|about|約|a few|数)", 1), group(norm, r"(?i)(\(approx\.\)|approx\.|approximately)$", 1))
    approximate = F.coalesce(best["approximate"], F.lit(False)) | (code == "APPROXIMATION")
    reason = F.when(refused.isNull(), F.lit(CLOSED)).when(promoted, F.lit(CLOSED_PROMOTED)).otherwise(F.lit(CLOSED_REFUSED))
    outside = F.concat(F.lit("dimension "), refused, F.lit(" is outside the expected dimensions: " + ", ".join(d for d in dimension_order() if d in ctx.dimensions)))
    each = [
        finding(code.isin("EMPTY", "NO_VALUE", "COMPOUND_OVERFLOW"), "skipped", code, whole),
        finding(code == "TIMEZONE_UNSUPPORTED", "skipped", code, let(group(norm, r"(\S+)$", 1), lambda w: at(w, F.length(norm) - F.length(w)))),
        finding(refused.isNotNull(), "skipped", "REJECTED_BY_POLICY", whole, outside),
        finding(code == "TYPO_CORRECTED", F.when(kind == "refused", "skipped").otherwise("ambiguity"), code, let(unit_word, lambda w: at(w, F.length(norm) - F.length(w)))),
        finding((code == "AMBIGUOUS_NUMBER") & (kind == "number"), "ambiguity", "AMBIGUOUS_NUMBER", whole, None, two),
        finding(auto & (kind == "quantity") & competes, "ambiguity", "AMBIGUOUS_NUMBER", doubt_in(norm, zero), None, two),
        finding(auto & is_range & doubtful(left), "ambiguity", "AMBIGUOUS_NUMBER", let(left_at, lambda n: doubt_in(left, n)), None, two),
        finding(auto & is_range & doubtful(right), "ambiguity", "AMBIGUOUS_NUMBER", let(right_at, lambda n: doubt_in(right, n)), None, two),
        finding(is_range & (best["low"] > best["high"]), "ambiguity", "AMBIGUOUS_NUMBER", whole, F.lit(FALLING), two),
        finding((code == "AMBIGUOUS_DATE"), "ambiguity", code, whole, None, F.greatest(two, F.size(best["dates"]) + 1)),
        finding((code == "AMBIGUOUS_UNIT"), "ambiguity", code, let(unit_word, lambda w: at(w, F.length(norm) - F.length(w))), None, F.lit(3)),
        finding(closed.isNotNull(), "ambiguity", "AMBIGUOUS_UNIT", whole, reason, two),
        finding((code == "AMBIGUOUS_CURRENCY"), "ambiguity", code, let(sign, lambda w: at(w, zero)), None, F.when(norm.rlike("(?i)cents?$"), 2).otherwise(3)),
        finding((kind == "number") & F.lit("length" in ctx.dimensions), "ambiguity", "UNIT_ASSUMED", whole, None, two),
        finding(approximate, F.when(strict, "skipped").otherwise("approximation"), "APPROXIMATION", F.coalesce(let(qualifier, lambda w: F.when(w.isNotNull(), F.when(F.startswith(norm, w), at(w, zero)).otherwise(at(w, F.length(norm) - F.length(w))))), whole)),
    ]
    # stable: findings of the same rank and text stay in this order
    there = F.transform(F.array_compact(F.array(*each)), placed)
    numbered = F.transform(there, lambda f, i: F.struct((-f["rank"]).alias("down"), f["ref_text"].cast("binary").alias("about"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(numbered), lambda x: x["f"])


def dimension_order() -> list[str]:
    """Dimensions as the registry lists them, temperature and currency behind."""
    return [*dict.fromkeys(row[3] for row in ROWS), "temperature", "currency"]


def outcome(ctx: Context) -> dict[str, Column]:
    """The columns that lead from _original, _norm, _best and _other to parsed, in their order."""
    col, allowed = F.col, lambda r: r["dimension"].isin(*ctx.dimensions) if ctx.dimensions else F.lit(True)
    read_ = ~col("_best.kind").isin("none", "refused")
    refused = F.when(read_ & col("_best.dimension").isNotNull() & ~allowed(col("_best")), col("_best.dimension"))
    inside = F.filter("_others", lambda o: o["dimension"].isNotNull() & allowed(o))
    kept = F.when(col("_refused").isNotNull(), F.concat(F.filter("_others", lambda o: ~o.eqNullSafe(col("_promoted"))), F.array("_best"))).otherwise(col("_others"))
    strict_out = F.lit(ctx.strictness == "strict") & F.coalesce(col("_best.approximate"), F.lit(False))
    best = F.when(col("_refused").isNotNull(), col("_promoted")).when(read_ & ~strict_out, col("_best"))
    clear = ~F.exists("_findings", lambda f: f["kind"] == "skipped") if ctx.strictness == "forgiving" else F.size("_findings") == 0
    return {
        "_closed": closed_compound(col("_norm"), col("_best"), ctx),
        "_others": competing(col("_norm"), col("_best"), col("_other"), col("_closed"), ctx),
        "_refused": refused,
        "_promoted": F.when(col("_refused").isNotNull(), F.get(inside, F.lit(0))),
        "_findings": found(col("_original"), col("_norm"), col("_best"), col("_others"), col("_closed"), col("_refused"), col("_promoted").isNotNull(), ctx),
        "parsed": F.struct(best.cast(DDL).alias("best"), kept.alias("alternatives"), col("_findings").alias("findings"), F.coalesce(clear & best.isNotNull(), F.lit(False)).alias("accepted")),
    }


def parse(df: DataFrame, column: str, ctx: Context = Context(), custom: DataFrame | None = None) -> DataFrame:
    """df with the struct column `parsed`: best (a reading, or null), alternatives, findings, accepted.

    findings are ordered by rank, then by the text they are about; start and end count bytes of the original text, of which
    ref_text is just that stretch. A reading outside the context's dimensions gives way to the first alternative inside them and
    becomes the last alternative itself. accepted: something was read and nothing refused; unless the context is forgiving,
    nothing doubtful or approximate either. Under strict, an approximate reading is no best reading.

    Distinct texts are parsed once. A null text has a null struct; a column of df named parsed is replaced, no other clashes.
    """
    wide = replace(ctx, strictness="forgiving" if ctx.strictness == "strict" else ctx.strictness)
    given = df.select(F.col(column).alias("_text")).filter(F.col(column).isNotNull()).distinct()
    texts = given.select(F.md5("_text").alias("_key"), F.col("_text").alias("_original"), normalized(F.col("_text")).alias("_norm"))
    token = F.regexp_extract("_norm", AROUND_DOUBT, 2)
    rewritten = F.when(F.contains(token, F.lit(",")), F.replace(token, F.lit(","), F.lit("."))).otherwise(F.replace(token, F.lit("."), F.lit("")))
    head, tail = F.regexp_extract("_norm", AROUND_DOUBT, 1), F.regexp_extract("_norm", AROUND_DOUBT, 3)
    doubted = F.col("_norm").rlike(DOUBTFUL) & ~tail.rlike(DOUBTFUL) & F.lit(ctx.number_format == "auto")
    ways = F.array_compact(F.array(F.struct(F.lit(True).alias("as_is"), F.col("_norm").alias("way")), F.when(doubted, F.struct(F.lit(False).alias("as_is"), F.concat(head, rewritten, tail).alias("way")))))
    rows = texts.select("_key", "_original", "_norm", F.explode(ways).alias("_w")).select("_key", "_original", "_norm", "_w.as_is", "_w.way")
    each = read(rows, "way", wide, custom, judge_dimensions=False)
    of = lambda as_is: F.max_by("reading", F.col("as_is") == F.lit(as_is))
    both = each.groupBy("_key").agg(F.max("_original").alias("_original"), F.max("_norm").alias("_norm"), of(True).alias("_best"), F.max_by(F.when(~F.col("as_is"), F.col("reading")), ~F.col("as_is")).alias("_other"))
    derived = once(df.sparkSession, "derived", ctx, build=lambda: outcome(ctx))
    for name, value in derived.items():
        both = both.withColumn(name, value)
    told = both.select("_key", "parsed")
    return joined_back(df.drop("parsed") if column != "parsed" else df, column, told)


def ranked_findings(df: DataFrame, column: str = "parsed") -> DataFrame:
    """A row per finding, worst first: the other columns, place (from 0) and the finding's fields."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.posexplode(F.col(column)["findings"]).alias("place", "_f")).select("*", "_f.*").drop("_f")
