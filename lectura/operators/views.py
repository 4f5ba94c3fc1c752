"""What was read, for people and for other programs: messages, field lists, JSON, and contexts from short tags."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import FIELDS, reading
from ..functions.render import humanize, json_string, reading_json
from ..sources.registry import ROWS
from .extract import extract
from .policy import ISSUES, accepts
from .read import Context, read

CONTRACT = "lectura/1"
#: What each code says in a message.
REASONS = {
    "EMPTY": "input is empty",
    "NO_VALUE": "no supported reading matched",
    "TIMEZONE_UNSUPPORTED": "the time zone can't be resolved",
    "REJECTED_BY_POLICY": "the field doesn't take this dimension",
    "COMPOUND_OVERFLOW": "a part reaches the unit above it",
    "TRAILING_INPUT": "text follows the reading and was not interpreted",
    "TYPO_CORRECTED": "the unit's spelling was corrected",
    "AMBIGUOUS_DATE": "the date can be read in several ways",
    "AMBIGUOUS_NUMBER": "the number can be read in several ways",
    "AMBIGUOUS_UNIT": "the unit can be read in several ways",
    "AMBIGUOUS_CURRENCY": "the currency can be read in several ways",
    "UNIT_ASSUMED": "the unit is not stated",
    "APPROXIMATION": "the value is approximate",
}
DIMENSIONS = ("currency", *dict.fromkeys(["temperature", *(row[3] for row in ROWS)]))


def _of_code(values: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), code)


def message(field: Column, text: Column, r: Column, strictness: str = "forgiving") -> Column:
    """Why a field isn't acceptable, and what was meant if that is known; null where it is acceptable."""
    code = F.coalesce(r["code"], F.lit("NO_VALUE"))
    meant = F.when(r["suggestion"].isNotNull(), F.concat(F.lit(" Did you mean `"), r["suggestion"], F.lit("`?"))).otherwise("")
    said = F.concat(F.lit("["), code, F.lit("] "), field, F.lit(": "), _of_code(REASONS, code), F.lit(" at `"), F.coalesce(text, F.lit("")), F.lit("`."), meant)
    return F.when(~accepts(r, strictness), said)


def issues_of(text: Column, r: Column) -> Column:
    """The findings of a reading: code, severity, rank, recoverable and the text they are about, worst first."""
    severity, rank, can = ({row[0]: row[k] for row in ISSUES} for k in (1, 2, 3))
    own = lambda c: F.struct(c.alias("code"), _of_code(severity, c).alias("severity"), _of_code(rank, c).alias("rank"), _of_code(can, c).alias("recoverable"), text.alias("ref_text"))
    return F.when(r["code"].isNull(), F.array().cast("array<struct<code:string,severity:string,rank:int,recoverable:boolean,ref_text:string>>")).otherwise(F.array(own(r["code"])))


def summary_json(text: Column, r: Column, strictness: str = "forgiving") -> Column:
    """{ok, input, best, issues} of a text and its reading, keys in this order."""
    issue = lambda i: F.concat(F.lit('{"code":'), json_string(i["code"]), F.lit(',"severity":'), json_string(i["severity"]), F.lit(',"rank":'), i["rank"].cast("string"), F.lit(',"ref_text":'), json_string(i["ref_text"]), F.lit("}"))
    best = F.when(F.coalesce(r["kind"].isin("none", "refused"), F.lit(True)), F.lit("null")).otherwise(reading_json(r))
    ok = F.when(accepts(r, strictness), "true").otherwise("false")
    return F.concat(F.lit('{"ok":'), ok, F.lit(',"input":'), json_string(F.coalesce(text, F.lit(""))), F.lit(',"best":'), best, F.lit(',"issues":['), F.array_join(F.transform(issues_of(text, r), issue), ","), F.lit("]}"))


def describe_parsed(text: Column, r: Column, locale: str | None = None, strictness: str = "forgiving") -> Column:
    """The whole outcome as object, summary and (name, value) fields."""
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    none = F.coalesce(r["kind"].isin("none", "refused"), F.lit(True))
    doubts, skipped = F.startswith(r["code"], F.lit("AMBIGUOUS_")) | r["code"].isin("TYPO_CORRECTED", "UNIT_ASSUMED"), none & r["code"].isNotNull()
    count = lambda c: F.when(c, 1).otherwise(0)
    others = sum((F.when(r[k].isNull(), 0).otherwise(F.size(r[k])) for k in ("others", "dates")), F.lit(0))
    fields = [field("input", text)] + ([field("locale", F.lit(locale))] if locale else [])
    fields += [field("ok", F.when(accepts(r, strictness), "true").otherwise("false")), field("skipped", count(skipped)), field("ambiguities", count(~none & doubts)), field("approximations", count(~none & (r["code"] == "APPROXIMATION"))), field("alternatives", others)]
    return F.struct(F.lit("lectura.parsed").alias("object"), F.when(none, "no supported reading").otherwise(humanize(r, locale)).alias("summary"), F.array(*fields).alias("fields"))


def locale_tag(tag: str) -> str | None:
    return {"": None, "ja-JP": "ja", "en-UK": "en-GB"}.get(tag, tag)


def dimension_set_tag(tag: str) -> tuple[str, ...]:
    """The dimensions a comma-separated list names; unknown members are dropped."""
    return tuple(d for d in (x.strip() for x in tag.split(",")) if d in DIMENSIONS)


def strictness_tag(tag: str) -> str:
    return tag if tag in ("confirm", "strict") else "forgiving"


def unreadable(tag: str) -> bool:
    """A list of dimensions of which none is known: a call with it is refused, not read without any restriction."""
    return bool(tag.strip()) and not dimension_set_tag(tag)


def tagged(locale: str = "", dimensions: str = "", strictness: str = "") -> Context:
    known = dimension_set_tag(dimensions) or ("length", "area")
    return Context(locale=locale_tag(locale), dimensions=known, registry=known, strictness=strictness_tag(strictness))


def read_json(df: DataFrame, column: str, locale: str = "", dimensions: str = "", strictness: str = "") -> DataFrame:
    """df with `json`, the summary of each text read under the tags; lengths and areas where no dimension is named."""
    if unreadable(dimensions):
        refused = reading("refused", F.lit(True), code="REJECTED_BY_POLICY")
        return df.withColumn("json", summary_json(F.col(column), refused))
    ctx = tagged(locale, dimensions, strictness)
    return read(df, column, ctx).withColumn("json", summary_json(F.col(column), F.col("reading"), ctx.strictness)).drop("reading")


def matches_json(docs: DataFrame, key: str, column: str, dimensions: tuple[str, ...] = ("length", "area")) -> DataFrame:
    """key and `json`, the array of a text's matches with their places in bytes and characters; [] where it has none."""
    number = lambda name, c: F.concat(F.lit(f'"{name}":'), F.col(c).cast("string"))
    places = [number(n, c) for n, c in (("start", "start"), ("end", "end"), ("byteStart", "start"), ("byteEnd", "end"), ("charStart", "char_start"), ("charEnd", "char_end"))]
    told = F.concat(F.lit("{"), F.concat_ws(",", *places, F.concat(F.lit('"text":'), json_string(F.col("text"))), F.concat(F.lit('"parsed":'), summary_json(F.col("text"), F.col("reading")))), F.lit("}"))
    each = extract(docs.select(F.col(key).alias("_key"), F.col(column).alias("_text")), "_text", dimensions).select("_key", F.struct("char_start", told.alias("json")).alias("m"))
    found = each.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["json"]), ",").alias("_all"))
    return docs.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.concat(F.lit("["), F.coalesce("_all", F.lit("")), F.lit("]")).alias("json"))


def input_schema() -> str:
    """The JSON schema of one text to be read."""
    own = {"text": {"type": "string"}, "locale": {"type": "string"}, "expected_dimension": {"type": "string"}, "strictness": {"enum": ["forgiving", "confirm", "strict"]}}
    return json.dumps({"$id": f"{CONTRACT}/input", "type": "object", "required": ["text"], "properties": own})


def output_schema() -> str:
    """The JSON schema of a summary."""
    kinds = {"string": "string", "double": "number", "boolean": "boolean"}
    best = {k: {"type": [kinds[t], "null"]} for k, t in FIELDS.items() if t in kinds and k not in ("low", "high", "code", "suggestion")}
    issue = {"code": {"enum": [row[0] for row in ISSUES]}, "severity": {"enum": ["error", "warning", "info"]}, "rank": {"type": "integer"}, "ref_text": {"type": "string"}}
    own = {"ok": {"type": "boolean"}, "input": {"type": "string"}, "best": {"type": ["object", "null"], "properties": best}, "issues": {"type": "array", "items": {"type": "object", "properties": issue}}}
    return json.dumps({"$id": f"{CONTRACT}/output", "type": "object", "required": list(own), "properties": own})


def tool_schema() -> str:
    """A tool description that takes one text."""
    return json.dumps({"name": "read_value", "description": "Reads one informal value.", "inputSchema": json.loads(input_schema())})
