"""Registered queries over whole outcomes: competing readings, ranked findings, places in the original, and the window scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.findings import parse, ranked_findings
from .operators.read import Context
from .operators.scan import scan
from .queries import narrow, query, s, table

FULL = ("0123456789", "０１２３４５６７８９")


def one_of(*texts: Column, key: str = "p_partkey") -> Column:
    """The text of a row by its key, in turn."""
    return F.get(F.array(*texts), (F.col(key) % len(texts)).cast("int"))


def text_of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def parsed_parts(spark: SparkSession, sf_dir: str, text: Column, ctx: Context) -> DataFrame:
    return parse(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "text", ctx)


def wide() -> Column:
    return F.translate(s("p_size"), *FULL)


VALUE = lambda r: F.round(r["value"], 6)
NUMBERS = narrow("registered", "temperature", "currency", "ambiguous_number", "number")


@query("""
SELECT p_partkey AS id,
  round(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 125 WHEN 1 THEN p_size + 0.125 WHEN 2 THEN p_size * 1000 + 125 ELSE (p_size + 0.125::DOUBLE - 32) * 5 / 9 END::DOUBLE, 6) AS value,
  round(CASE p_partkey % 4 WHEN 0 THEN p_size + 0.125 WHEN 1 THEN p_size * 1000 + 125 WHEN 2 THEN p_size + 0.125 ELSE (p_size * 1000 + 125 - 32)::DOUBLE * 5 / 9 END::DOUBLE, 6) AS other,
  CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'm' WHEN 2 THEN 'JPY' ELSE 'C' END AS unit,
  'AMBIGUOUS_NUMBER' AS code, p_size || CASE WHEN p_partkey % 2 = 0 THEN ',125' ELSE '.125' END AS ref_text,
  CASE WHEN p_partkey % 4 = 2 THEN 2 ELSE 0 END::BIGINT AS start, (CASE WHEN p_partkey % 4 = 2 THEN 6 ELSE 4 END + length(p_size::VARCHAR))::BIGINT AS "end", 1 AS n_findings, true AS accepted
FROM part
""")
def doubtful_quantities(spark, sf_dir):
    """A unit doesn't settle what the separator of its number means: both values, and where the number stands."""
    df = parsed_parts(spark, sf_dir, one_of(text_of(s("p_size"), ",125 kg"), text_of(s("p_size"), ".125 m"), text_of("¥", s("p_size"), ",125"), text_of(s("p_size"), ".125 °F")), NUMBERS)
    best, other, finding = F.col("parsed.best"), F.col("parsed.alternatives")[0], F.col("parsed.findings")[0]
    return df.select("id", VALUE(best).alias("value"), VALUE(other).alias("other"), other["unit"].alias("unit"), finding["code"].alias("code"), finding["ref_text"].alias("ref_text"), finding["start"].alias("start"), finding["end"].alias("end"), F.size("parsed.findings").alias("n_findings"), "parsed.accepted")


@query("""
WITH f AS (
  SELECT p_partkey AS id, 90 AS rank, 'REJECTED_BY_POLICY' AS code, CASE p_partkey % 3 WHEN 0 THEN 'about ' || p_size || ',125 kg' ELSE p_size || ',125-' || (p_size + 1) || ',125 kg' END AS ref_text, 0::BIGINT AS start FROM part WHERE p_partkey % 3 < 2
  UNION ALL SELECT p_partkey, 55, 'AMBIGUOUS_NUMBER', p_size || ',125', CASE p_partkey % 3 WHEN 0 THEN 6 ELSE 0 END FROM part WHERE p_partkey % 3 < 2
  UNION ALL SELECT p_partkey, 55, 'AMBIGUOUS_NUMBER', (p_size + 1) || ',125', length(p_size::VARCHAR) + 5 FROM part WHERE p_partkey % 3 = 1
  UNION ALL SELECT p_partkey, 30, 'APPROXIMATION', 'about', 0 FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 100, 'EMPTY', '', 2 FROM part WHERE p_partkey % 3 = 2
)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY rank DESC, ref_text) - 1)::INT AS place, code, rank, CASE rank WHEN 30 THEN 'warning' WHEN 55 THEN 'warning' ELSE 'error' END AS severity, ref_text, start, start + strlen(ref_text) AS "end" FROM f
""")
def findings_in_order(spark, sf_dir):
    """Texts of one and of three findings, worst first."""
    text = one_of(text_of("about ", s("p_size"), ",125 kg"), text_of(s("p_size"), ",125-", (F.col("p_size") + 1).cast("string"), ",125 kg"), F.lit("  "))
    df = parsed_parts(spark, sf_dir, text, narrow("registered", "ambiguous_number", "number", ranges=True, fuzzy=True, dimensions=("length",)))
    return ranked_findings(df.drop("text")).select("id", "place", "code", "rank", "severity", "ref_text", "start", "end")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'APPROXIMATION' WHEN 1 THEN 'TYPO_CORRECTED' WHEN 2 THEN 'AMBIGUOUS_NUMBER' WHEN 3 THEN 'NO_VALUE' ELSE 'AMBIGUOUS_NUMBER' END AS code,
  CASE p_partkey % 5 WHEN 0 THEN '約' WHEN 1 THEN 'ｍｅｔｅｒｚ' WHEN 2 THEN translate(p_size::VARCHAR, '0123456789', '０１２３４５６７８９') || ',１２５' WHEN 3 THEN p_size || '㎞ no' ELSE p_size || ',125' END AS ref_text,
  CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 + length(p_size::VARCHAR) WHEN 4 THEN 3 ELSE 0 END::BIGINT AS start, true AS same
FROM part
""")
def findings_in_the_original(spark, sf_dir):
    """Places count bytes of what was typed, whatever normalisation made of it."""
    text = one_of(
        text_of("  約", wide(), "㎏"), text_of("​", s("p_size"), " ｍｅｔｅｒｚ"), text_of(wide(), ",１２５"), text_of(s("p_size"), "㎞ no"), text_of("　", s("p_size"), ",125​ ㎏"),
    )
    df = parsed_parts(spark, sf_dir, text, narrow("registered", "ambiguous_number", "number", "typo_corrected", fuzzy=True))
    each = ranked_findings(df)
    cut = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return each.select("id", "code", "ref_text", "start", (cut == F.col("ref_text").cast("binary")).alias("same"))


@query("""
SELECT p_partkey AS id, p_size * 1000.0::DOUBLE AS value, 'L' AS unit, round(p_size + 0.03::DOUBLE, 6) AS other, 'm' AS other_unit, 'AMBIGUOUS_UNIT' AS code, p_size || 'm3' AS ref_text FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_size * 1000.0::DOUBLE, 'L', NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 2 = 1
""")
def closed_compounds(spark, sf_dir):
    """Written together, a registry unit can also be metres and centimetres; with a blank between it can't."""
    df = parsed_parts(spark, sf_dir, one_of(text_of(s("p_size"), "m3"), text_of(s("p_size"), " m3")), narrow("registered", "metric_idiom", "number"))
    other, finding = F.get("parsed.alternatives", F.lit(0)), F.get("parsed.findings", F.lit(0))
    return df.select("id", VALUE(F.col("parsed.best")).alias("value"), "parsed.best.unit", VALUE(other).alias("other"), other["unit"].alias("other_unit"), finding["code"].alias("code"), finding["ref_text"].alias("ref_text"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN 'length' END AS best_dimension, CASE p_partkey % 5 WHEN 3 THEN p_size::DOUBLE WHEN 4 THEN round(p_size + 0.03::DOUBLE, 6) END AS value,
  CASE p_partkey % 5 WHEN 0 THEN 'concentration' WHEN 1 THEN 'power' WHEN 2 THEN 'mass' WHEN 3 THEN 'length' ELSE 'volume' END AS alternative_dimension,
  CASE p_partkey % 5 WHEN 0 THEN 'dimension concentration' WHEN 1 THEN 'dimension power' WHEN 2 THEN 'dimension mass' WHEN 4 THEN 'dimension volume' END || ' is outside the expected dimensions: length, area' AS reason,
  p_partkey % 5 = 3 AS accepted
FROM part
""")
def expected_dimensions(spark, sf_dir):
    """A reading of another dimension gives way to one that is expected, or to none; a bare number has no dimension to refuse."""
    text = one_of(text_of(s("p_size"), " mM"), text_of(s("p_size"), " W"), text_of(s("p_size"), "-", (F.col("p_size") + 5).cast("string"), " kg"), s("p_size"), text_of(s("p_size"), "m3"))
    df = parsed_parts(spark, sf_dir, text, narrow("registered", "metric_idiom", "number", ranges=True, dimensions=("area", "length")))
    refused = F.get(F.filter("parsed.findings", lambda f: f["code"] == "REJECTED_BY_POLICY"), F.lit(0))
    return df.select("id", F.col("parsed.best.dimension").alias("best_dimension"), VALUE(F.col("parsed.best")).alias("value"), F.get("parsed.alternatives", F.lit(0))["dimension"].alias("alternative_dimension"), refused["reason"].alias("reason"), "parsed.accepted")


@query("""
SELECT p_partkey AS id, u.place AS place, p_size * 1000.0 + 234 AS low, (p_size + 1) * 1000.0 + 300 AS high, CASE u.place WHEN 0 THEN p_size || ',234' ELSE (p_size + 1) || ',300' END AS ref_text,
  CASE u.place WHEN 0 THEN 5 ELSE 13 + length(p_size::VARCHAR) END::BIGINT AS start
FROM part, (VALUES (0), (1)) AS u(place)
""")
def endpoint_doubts(spark, sf_dir):
    """Each end of a range has its own doubt, at its own place."""
    df = parsed_parts(spark, sf_dir, text_of("from ", s("p_size"), ",234 to ", (F.col("p_size") + 1).cast("string"), ",300 m"), narrow("registered", "ambiguous_number", "number", ranges=True))
    each = ranked_findings(df.select("id", F.round("parsed.best.low", 6).alias("low"), F.round("parsed.best.high", 6).alias("high"), "parsed"))
    first = F.rank().over(Window.partitionBy("id").orderBy("start")) - 1
    return each.select("id", first.alias("place"), "low", "high", "ref_text", "start")


@query("SELECT p_partkey AS id, p_partkey % 4 = 0 AS confirmed, p_partkey % 4 < 2 AND p_partkey % 4 = 0 AS strict, p_partkey % 4 <> 3 AS forgiving FROM part")
def acceptance(spark, sf_dir):
    """What a field takes: anything read, only what is sure, or that under strict."""
    text = one_of(text_of(s("p_size"), ".5 kg"), text_of(s("p_size"), ",125 kg"), text_of("約", s("p_size"), "kg"), F.lit("n/a"))
    told = []
    for strictness in ("confirm", "strict", "forgiving"):
        name = "confirmed" if strictness == "confirm" else strictness
        told.append(parsed_parts(spark, sf_dir, text, narrow("registered", "ambiguous_number", "number", fuzzy=True, strictness=strictness)).select("id", F.col("parsed.accepted").alias(name)))
    return told[0].join(told[1], "id").join(told[2], "id")


SENTENCE = """
  SELECT p_partkey AS id, p_size AS n, length(p_size::VARCHAR) AS d, translate(p_size::VARCHAR, '0123456789', '０１２３４５６７８９') AS w FROM part
"""


@query(f"""
WITH t AS ({SENTENCE})
SELECT id, 0 AS clause, n || '尺3寸' AS text, 11::BIGINT AS start, 18 + d AS "end", round(n * (10.0 / 33) + 3 * (1.0 / 33), 6) AS value, NULL::VARCHAR AS residue, 'length' AS hint FROM t
UNION ALL SELECT id, 1, '約' || w || 'ｃｍ', 28 + d, 37 + 4 * d, n * 0.01::DOUBLE, NULL, NULL FROM t
UNION ALL SELECT id, 2, '1 234', 51 + 4 * d, 56 + 4 * d, 1234.0, 'apples', 'length' FROM t
UNION ALL SELECT id, 3, '六帖', 73 + 4 * d, 79 + 4 * d, 9.72, NULL, NULL FROM t
""")
def scanned_windows(spark, sf_dir):
    """Measures inside sentences: traditional lengths, full width, grouped digits with a residue, CJK numerals; identifiers don't count."""
    text = text_of("奥行き: ", s("p_size"), "尺3寸 の板、約", wide(), "ｃｍ と幅 x、w 1 234 apples ;beamA7m ", "六帖")
    return scan(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("note")), "note").select(
        "id", "clause", "text", "start", "end", F.round("reading.value", 6).alias("value"), "residue", "hint"
    )
