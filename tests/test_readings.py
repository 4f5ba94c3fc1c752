"""Readings of small texts, and the registered queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectura.functions import numbers, times
from lectura.functions.render import exact_number, rounded_number
from lectura.functions.text import normalized
from lectura.operators.policy import accepts
from lectura.operators.read import Context, read, suggestions
from lectura.operators.views import input_schema, locale_tag, matches_json, output_schema, read_json, strictness_tag, tool_schema, unreadable
from lectura.queries import ORACLE_SQL, QUERIES
from lectura.sources.registry import ROWS
from lectura.streaming.read import read_stream

SF = "/root/testdata/sf0.001"
QUICK = ["flagship", "registered_length", "range_hyphen", "iso_date", "suggested_units", "canonical_batch", "editor_extract", "editor_places", "completions", "completed_readings", "humanized_japanese", "summary_json", "repair_messages", "misspelt_units", "dates_in_languages"]


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_registry_names_each_spelling_once():
    seen = {}
    for _, unit, *_, aliases in ROWS:
        for a in aliases:
            assert seen.setdefault(a, unit) == unit, a
    assert len(ROWS) == 100


def test_numbers(spark):
    cases = {"1,234.5": 1234.5, "1.234,56": 1234.56, "1 234": 1234.0, "12,34,567": 1234567.0, "2億": 2e8, "3万5000": 35000.0, "百二十三": 123.0, "1½": 1.5, "two hundred and five": 205.0, "1e5": None, "": None, "abc": None, None: None, "9" * 400: None}
    assert column(spark, cases, numbers.number) == pytest.approx(list(cases.values()), nan_ok=True)


def test_clock_and_duration(spark):
    assert column(spark, ["3pm", "14:30", "午後3時半", "25:00", "noon"], times.clock_seconds) == [54000.0, 52200.0, 55800.0, None, 43200.0]
    assert column(spark, ["PT1H30M", "2d4h", "1h30", "P", "1 hour and 30 minutes"], times.duration_seconds) == [5400.0, 187200.0, 5400.0, None, 5400.0]


def test_normalisation(spark):
    assert column(spark, ["　５㎏ ", "１，０００", None], normalized) == ["5kg", "1,000", None]


def test_nulls_blanks_and_unreadable_texts_have_defined_readings(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, " ", "x"), (3, "no", "x"), (4, "5 kg", "x"), (4, "5 kg", "x")], "id int, text string, reading_note string")
    rows = read(df, "text", Context(only=("registered",), ranges=False, conversions=False, fuzzy=False)).withColumn("ok", accepts(F.col("reading"))).orderBy("id").collect()
    assert [r.ok for r in rows] == [False, False, False, True, True]
    assert rows[0].reading is None and rows[1].reading.code == "EMPTY" and rows[2].reading.code == "NO_VALUE"


VARIED = {
    # words, numerals and grouping before a unit
    "twenty-five kg": ("quantity", 25.0, "kg", None), "two hundred and five km": ("quantity", 205000.0, "m", None),
    "五キログラム": ("quantity", 5.0, "kg", None), "百二十平方メートル": ("quantity", 120.0, "m2", None),
    "3万5000 m": ("quantity", 35000.0, "m", None), "1 234,56 m": ("quantity", 1234.56, "m", None), "an hour": ("quantity", 3600.0, "s", None),
    # misspelt units
    "12 metrs": ("quantity", 12.0, "m", "TYPO_CORRECTED"), "3 kilogrmos": ("quantity", 3.0, "kg", "TYPO_CORRECTED"),
    "7 kilomètres": ("quantity", 7000.0, "m", "TYPO_CORRECTED"), "7 minites": ("quantity", 420.0, "s", "TYPO_CORRECTED"),
    "5 pouunds": ("quantity", 2.26796185, "kg", "TYPO_CORRECTED"), "10平目": ("quantity", 10.0, "m2", "TYPO_CORRECTED"),
    "8 heurs": ("quantity", 28800.0, "s", "TYPO_CORRECTED"), "5 zzzzzz": ("none", None, None, "NO_VALUE"), "5 €€": ("none", None, None, "NO_VALUE"),
    # durations and clocks with zones
    "an hour and a half": ("quantity", 5400.0, "s", None), "9:00 Asia/Tokyo": ("quantity", 0.0, "s", None),
    "3pm America/New_York": ("quantity", 68400.0, "s", None), "3pm Mars/Olympus": ("refused", None, None, "TIMEZONE_UNSUPPORTED"),
    "5pm UTC+5:30": ("quantity", 41400.0, "s", None), "5pm UTC+25": ("none", None, None, "NO_VALUE"),
}


def test_varied_texts_read(spark):
    df = spark.createDataFrame([(t,) for t in VARIED], "text string")
    got = {r.text: r.reading for r in read(df, "text", Context(reference_date="2026-07-19")).collect()}
    for text, (kind, value, unit, code) in VARIED.items():
        r = got[text]
        assert (r.kind, r.unit, r.code) == (kind, unit, code), (text, r)
        assert r.value == (None if value is None else pytest.approx(value)), (text, r)
    strict = read(df.filter("text = '12 metrs'"), "text", Context(strictness="strict")).first().reading
    assert (strict.kind, strict.code, strict.suggestion) == ("refused", "TYPO_CORRECTED", "m")


def test_dates_in_several_languages(spark):
    want = {
        "mañana": "2026-07-20", "pasado mañana": "2026-07-21", "vendredi prochain": "2026-07-24", "sexta-feira que vem": "2026-07-24", "demain": "2026-07-20",
        "明後日": "2026-07-21", "一昨日": "2026-07-17", "来週金曜日": "2026-07-24", "今週金曜日": "2026-07-24", "先週金曜日": "2026-07-17", "后天": "2026-07-21",
        "下周五": "2026-07-24", "next sunday": "2026-07-26", "this sunday": "2026-07-19", "last sunday": "2026-07-12", "next lunes": "2026-07-20", "next year": None,
    }
    assert column(spark, want, lambda t: times.relative_date(t, F.lit("2026-07-19").cast("date"))["date"]) == list(want.values())


def test_slash_texts_are_fractions_that_may_be_dates(spark):
    reads = lambda locale: column(spark, ["5/6", "5/25", "2/31", "4/0", "x/2"], lambda t: times.slash_fraction(t, F.lit("2026-07-19").cast("date"), locale))
    told = [(r.value, r.dates) if r else None for r in reads(None)]
    assert told == [(pytest.approx(5 / 6), ["2026-05-06", "2026-06-05"]), (0.2, ["2026-05-25"]), None, None, None]
    assert reads("en-GB")[0].dates == ["2026-06-05", "2026-05-06"]


def test_fuzzy_temperatures_need_the_dimension(spark):
    df = spark.createDataFrame([("warm",), ("とても寒い",), ("7",)], "text string")
    got = {r.text: (r.reading.low, r.reading.high) for r in read(df, "text", Context(dimensions=("temperature",), only=("number",))).collect()}
    assert got == {"warm": (20.0, 27.0), "とても寒い": (0.0, 10.0), "7": (None, None)}
    assert {r.reading.kind for r in read(df, "text", Context(only=("number",))).collect()} == {"none", "number"}


def test_clashing_columns_survive(spark):
    df = spark.createDataFrame([("5 cm", 1, 2, 3, 4, 5, "old")], "text string, _text int, _key int, _norm int, u int, _w int, reading string")
    row = read(df, "text", Context(only=("registered",), ranges=False, conversions=False, fuzzy=False)).first()
    assert (row["_text"], row["_key"], row["_norm"], row["u"], row["_w"], row.reading.value) == (1, 2, 3, 4, 5, 0.05)
    assert suggestions(df, "text").first()["_w"] == 5


def test_a_stream_reads_like_a_batch(spark, tmp_path):
    spark.createDataFrame([("5 cm", 8), ("7 kg", 9)], "text string, u int").write.parquet(str(tmp_path / "in"))
    ctx = Context(only=("registered",), ranges=False, conversions=False, fuzzy=False)
    stream = read_stream(spark.readStream.schema("text string, u int").parquet(str(tmp_path / "in")), "text", ctx)
    done = stream.writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted((r.v, r.u) for r in spark.sql("select reading.value v, u from told").collect()) == [(0.05, 8), (7.0, 9)]


def test_exact_numbers(spark):
    want = {0.1: "0.1", -0.0: "0", 1e23: "1" + "0" * 23, 2e23: "2" + "0" * 23, 1e-7: "0.0000001", -2.5: "-2.5", 1 / 3: "0.3333333333333333", 2.0**70: "1180591620717411300000", float("inf"): "unrepresentable"}
    df = spark.createDataFrame([(v,) for v in want], "v double").select("v", exact_number(F.col("v")).alias("t"), rounded_number(F.col("v")).alias("r"))
    rows = {r.v: r for r in df.collect()}
    assert {v: rows[v].t for v in want} == want
    assert rows[1 / 3].r == "0.333333" and rows[1e-7].r == "0"


def test_json_of_matches_and_tags(spark):
    df = spark.createDataFrame([(1, "幅3640 and 2、 é 5 m"), (2, "nothing"), (None, None)], "id int, note string")
    got = {r.id: json.loads(r.json) for r in matches_json(df, "id", "note").collect()}
    assert [(m["text"], m["byteStart"], m["byteEnd"], m["charStart"], m["charEnd"]) for m in got[1]] == [("3640", 3, 7, 1, 5), ("5 m", 20, 23, 15, 18)]
    assert [m["parsed"]["issues"][0]["code"] for m in got[1] if m["parsed"]["issues"]] == ["TRAILING_INPUT"]
    assert got[2] == [] and got[None] == []
    texts = spark.createDataFrame([("5 kg",), ("5 m\x80",)], "text string")
    told = lambda **tags: {r.text: json.loads(r.json) for r in read_json(texts, "text", **tags).collect()}
    assert told(dimensions="mass, nope")["5 kg"]["best"]["value"] == 5
    assert not told()["5 kg"]["ok"] and told(dimensions="nope")["5 kg"]["issues"][0]["code"] == "REJECTED_BY_POLICY"
    assert locale_tag("en-UK") == "en-GB" and strictness_tag("x") == "forgiving" and unreadable("nope") and not unreadable(" ")
    assert all(json.loads(x()) for x in (input_schema, output_schema, tool_schema))


def same(spark, name, sql, run):
    con = duckdb.connect()
    for t in "part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(sql).df(), run(spark, SF).toPandas()
    assert set(want.columns) == set(got.columns)
    tidy = lambda x: sorted(repr([None if v is None or v != v else round(v, 5) if isinstance(v, float) else v for v in r]) for r in x[sorted(x.columns)].astype(object).values.tolist())
    assert tidy(want) == tidy(got)


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_sql(spark, name):
    same(spark, name, ORACLE_SQL[name], QUERIES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
