"""Whole outcomes: competing readings, findings in order, places in the original, windows in free text, completions."""

import pytest
from pyspark.sql import functions as F

from lectura.functions.windows import windows_of
from lectura.operators.complete import complete, complete_readings
from lectura.operators.features import narrowed
from lectura.operators.findings import FALLING, parse, ranked_findings
from lectura.operators.read import Context, read
from lectura.operators.scan import scan

NUMBERS = ("registered", "ambiguous_number", "number")


def narrow(*grammars, **settings):
    """Few grammars keep plans small."""
    return Context(**{"only": NUMBERS + grammars, "conversions": False, "ranges": False, "fuzzy": False} | settings)


def parsed(spark, texts, ctx):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: r.parsed for r in parse(df, "text", ctx).collect()}


def codes(p):
    return [(f.code, f.ref_text, f.start, f.end) for f in p.findings]


def test_a_unit_does_not_settle_a_doubtful_number(spark):
    cases = [
        ("1.234 kg", 1.234, 1234.0, "kg"), ("1,234 kg", 1234.0, 1.234, "kg"), ("1.234 hours", 4442.4, 4442400.0, "s"), ("1.234 USD", 1.234, 1234.0, "USD"), ("1.234 m", 1.234, 1234.0, "m"), ("0.123 kg", 0.123, 123.0, "kg"),
        ("0,123 m2", 123.0, 0.123, "m2"), ("12,345 cm", 123.45, 0.12345, "m"), ("1.234 F", -17.092222222222, 667.777777777778, "C"), ("¥1,234", 1234.0, 1.234, "JPY"), ("1.234", 1.234, 1234.0, None), ("about 1,234 kg", 1234.0, 1.234, "kg"),
    ]
    settled = ["1.23 kg", "1.2345 kg", "1234.567 kg", "1.234,56 kg", "1,234.56 kg", "1.234.567 kg", "5 kg", "0.000 kg"]
    got = parsed(spark, [c[0] for c in cases] + settled, narrow("temperature", "currency", fuzzy=True))
    for text, value, other, unit in cases:
        p = got[text]
        assert (round(p.best.value, 9), p.best.unit) == (pytest.approx(value), unit), text
        assert [round(a.value, 6) for a in p.alternatives] == [pytest.approx(other)] and p.alternatives[0].unit == unit, text
        assert p.alternatives[0].confidence < p.best.confidence
        number = text.replace("¥", "").replace("about ", "").split(" ")[0]
        start = len(text.encode()) - len(text[text.index(number) :].encode())
        assert codes(p)[0] == ("AMBIGUOUS_NUMBER", number, start, start + len(number)), text
    for text in settled:
        assert got[text].findings == [] and got[text].alternatives == [] and got[text].accepted, text
    declared = parsed(spark, ["1.234 kg"], narrow(number_format="comma_decimal"))["1.234 kg"]
    assert declared.best.value == 1234.0 and declared.findings == [] and declared.alternatives == []


def test_closed_compounds_and_expected_dimensions(spark):
    free = parsed(spark, ["5m3", "5 m3", "1m80", "5ft2"], narrow("metric_idiom", "feet_inches"))
    assert (free["5m3"].best.value, free["5m3"].best.unit, free["5m3"].alternatives[0].value) == (5000.0, "L", 5.03)
    assert codes(free["5m3"]) == [("AMBIGUOUS_UNIT", "5m3", 0, 3)]
    assert (free["5ft2"].best.unit, round(free["5ft2"].alternatives[0].value, 4)) == ("m2", 1.5748)
    for text, value in (("5 m3", 5000.0), ("1m80", 1.8)):
        assert free[text].best.value == value and free[text].alternatives == [] and free[text].findings == []
    length = parsed(spark, ["5m3", "5 mM", "5 W", "5mA", "3640", "5-10 kg", "about 1,234 kg", "$5"], narrow("metric_idiom", "currency", dimensions=("length",), ranges=True, fuzzy=True))
    p = length["5m3"]
    assert (p.best.value, p.best.unit, p.alternatives[-1].unit, p.accepted) == (5.03, "m", "L", False)
    assert [f.code for f in p.findings] == ["REJECTED_BY_POLICY", "AMBIGUOUS_UNIT"] and "so the compound was read" in p.findings[1].reason
    for text, dimension in (("5 mM", "concentration"), ("5 W", "power"), ("5mA", "current"), ("5-10 kg", "mass")):
        p = length[text]
        assert p.best is None and len(p.alternatives) == 1 and p.alternatives[0].dimension == dimension, text
        assert p.findings[0].reason == f"dimension {dimension} is outside the expected dimensions: length"
    assert length["3640"].best.kind == "number" and length["3640"].alternatives[0].unit == "mm" and length["3640"].findings[0].code == "UNIT_ASSUMED"
    assert [f.rank for f in length["about 1,234 kg"].findings] == [90, 55, 30]
    assert length["$5"].best is None and [a.unit for a in length["$5"].alternatives] == ["CAD", "AUD", "USD"]


def test_each_end_of_a_range_has_its_own_doubt(spark):
    cases = {
        "1.234-2.345 kg": [("1.234", 0, 5), ("2.345", 6, 11)], "1.234-1.234": [("1.234", 0, 5), ("1.234", 6, 11)], "1.234 to 1.234": [("1.234", 0, 5), ("1.234", 9, 14)], "between 1.234 and 1.234": [("1.234", 8, 13), ("1.234", 18, 23)],
        "from 1.234 to 1.234": [("1.234", 5, 10), ("1.234", 14, 19)], "1.234〜1.234": [("1.234", 0, 5), ("1.234", 8, 13)], "1.234..1.234": [("1.234", 0, 5), ("1.234", 7, 12)], "1.5-2.5 kg": [],
    }
    got = parsed(spark, [*cases, "9 to 2 kg"], narrow(ranges=True))
    for text, doubts in cases.items():
        assert got[text].best and [(f.ref_text, f.start, f.end) for f in got[text].findings] == doubts, text
    falling = got["9 to 2 kg"].findings
    assert [(f.code, f.reason, f.ref_text) for f in falling] == [("AMBIGUOUS_NUMBER", FALLING, "9 to 2 kg")]


ORIGINALS = [
    "５ ｍｅｔｅｒｚ", "３ meterz", "１　meterz", "1 meterz", "1​ meterz", "1 ​meterz", "﻿1 meterz", "１．５ meterz", "  ３ ｍｅｔｅｒｚ", "１,２３４", "１,２３４  ", "約 5 ㎞", "約２０ｋｇ", "5㎞ 3 zzzz", "", "   ", "​", "　", "éxtra",
    "１．５ｍ", "５ cups", "$１２", "０５/０６/２０２６", "﻿１,０００円", "３ ㎏,", None,
]


def test_places_are_those_of_the_original(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ORIGINALS)], "id int, text string")
    out = parse(df, "text", narrow("typo_corrected", "cups", "currency", fuzzy=True, locale="ja"))
    rows = {r.text: r.parsed for r in out.collect()}
    assert rows[None] is None
    for text, p in rows.items():
        for f in p.findings if p else []:
            assert text.encode()[f.start : f.end].decode() == f.ref_text, (text, f)
    typo = {t: [(f.start, f.end) for f in p.findings if f.code == "TYPO_CORRECTED"] for t, p in rows.items() if p}
    assert typo["５ ｍｅｔｅｒｚ"] == [(4, 22)] and typo["  ３ ｍｅｔｅｒｚ"] == [(6, 24)] and typo["1 ​meterz"] == [(5, 11)] and typo["﻿1 meterz"] == [(5, 11)]
    assert codes(rows["１,２３４  "]) == [("AMBIGUOUS_NUMBER", "１,２３４", 0, 13)] and codes(rows["約 5 ㎞"]) == [("APPROXIMATION", "約", 0, 3)]
    assert codes(rows["5㎞ 3 zzzz"]) == [("NO_VALUE", "5㎞ 3 zzzz", 0, 11)] and [f.code for f in rows["   "].findings] == ["EMPTY"]
    assert codes(rows["$１２"]) == [("AMBIGUOUS_CURRENCY", "$", 0, 1)] and codes(rows["５ cups"]) == [("AMBIGUOUS_UNIT", "cups", 4, 8)]
    flat = ranked_findings(out.drop("text")).groupBy("id").agg(F.collect_list(F.struct("place", "rank")).alias("f")).collect()
    assert all([x["place"] for x in r.f] == list(range(len(r.f))) and [-x["rank"] for x in r.f] == sorted(-x["rank"] for x in r.f) for r in flat)


def test_strictness_and_repeated_rows(spark):
    texts = ["1.5 kg", "1.234 kg", "約5kg"]
    for strictness, accepted in (("forgiving", [True, True, True]), ("confirm", [True, False, False]), ("strict", [True, False, False])):
        got = parsed(spark, texts, narrow(strictness=strictness, fuzzy=True))
        assert [got[t].accepted for t in texts] == accepted
    assert got["約5kg"].best is None and got["約5kg"].findings[0].kind == "skipped"
    many = spark.createDataFrame([(i, "1,234 m", 1) for i in range(50)], "id int, text string, _key int")
    assert parse(many, "text", narrow()).filter("parsed.best.value = 1234 and _key = 1").count() == 50
    assert parse(many.limit(0), "text", narrow()).count() == 0


SCANS = [
    ("幅3m×奥行4m、予算1234、予算¥999、next friday、6帖、寸法3640、壁厚105mm、幅１．５ｍ", ["3m", "4m", "6帖", "3640", "105mm", "１．５ｍ"]),
    ("寸法１ ２００", ["１ ２００"]),
    ("部材3640、備考1234、north 800、somewidth 700、grossarea 800、subfloor area 1100、room width 900、room w 910、floor area 12㎡、wall thickness 105mm", ["900", "910", "12㎡", "105mm"]),
    ("floor area 105mm、wall thickness 12㎡、floor area 1200、floor area 12㎡、wall thickness 105mm", ["12㎡", "105mm"]),
    ("beamA105mm、part_1200mm、room width900mm、壁厚105mm", ["900mm", "105mm"]),
    ("幅3640 and 2", ["3640"]), ("幅3640 x 2", ["3640"]), ("幅3640 2", ["3640"]), ("幅1 234 567 apples", ["1 234 567"]), ("幅5 meterz", ["5 meterz"]), ("高さ5尺3寸 と六帖", ["5尺3寸", "六帖"]), ("約5 m, 7 kg, 1,5 m", ["約5 m", "1,5 m"]), ("", []), (None, []),
]


def test_windows_in_free_text(spark):
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(SCANS)], "id int, note string, at int")
    rows = scan(df, "note").collect()
    for i, (text, wanted) in enumerate(SCANS):
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.start)
        assert [r.text for r in own] == wanted, text
        for r in own:
            assert text[r.char_start : r.char_end] == r.text and text.encode()[r.start : r.end].decode() == r.text
    of = {(r.id, r.text): r for r in rows}
    assert of[5, "3640"].residue == "and" and of[5, "3640"].code == "TRAILING_INPUT" and of[8, "1 234 567"].reading.value == 1234567.0
    assert of[0, "3640"].code == "UNIT_ASSUMED" and round(of[0, "6帖"].reading.value, 6) == 9.72 and of[9, "5 meterz"].reading.value == 5.0
    assert of[9, "5 meterz"].code == "TYPO_CORRECTED" and of[9, "5 meterz"].residue is None


def test_windows_take_linear_time():
    long = "幅3640 and 2、" * 20000
    found = windows_of(long)
    assert len(found) == 40000 and found[-1]["start"] == len(long.encode()) - len("2、".encode())


def test_completions_by_prefix(spark):
    custom = spark.createDataFrame([("smoot", "m", "length", 1.7018, False, ["smoot", "smoots"])], "unit string, canonical string, dimension string, factor double, approximate boolean, aliases array<string>")
    typed = spark.createDataFrame([("5 smo",), ("KILOG",), ("",), ("qqq",)], "text string")
    got = complete(typed, "text", custom=custom).collect()
    assert {r.value for r in got if r.text == "5 smo"} == {"smoot", "smoots"} and "kg" in {r.canonical for r in got if r.text == "KILOG"}
    assert {r.text for r in got} == {"5 smo", "KILOG"}
    offers = complete_readings(spark.createDataFrame([("5",)], "text string"), "text", narrow(dimensions=("area",))).collect()
    assert len({(r.reading.value, r.reading.unit) for r in offers}) == len(offers)


def test_fuzzy_terms_are_joined(spark):
    terms = tuple((f"term {i}", float(i), i + 1.0, "m", "length") for i in range(5000))
    df = spark.createDataFrame([("Term 7",), ("term 4999",), ("term x",)], "text string")
    ctx = Context(only=("number",), ranges=False, conversions=False, fuzzy_terms=terms)
    out = read(df, "text", ctx)
    assert {(r.text, r.reading.low) for r in out.collect()} == {("Term 7", 7.0), ("term 4999", 4999.0), ("term x", None)}
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000


MIXED = ["5 cm", "from 1 to 3 kg", "EUR 5", "3万", "5尺3寸", "6帖", "20㎡", "70 F", "3 yd 2 ft", "1m80", "3pm EST", "14:30", "PT1H30M", "5ft 11", "2 cups", "1,234", "7 minites", "3pm Mars/Olympus", "1/2", "5/6/2026", "tomorrow", "about 5 kg", "a few minutes", "10 ± 0.5 mm", "under 5 kg", "5 in to cm", "an hour and a half", "$5", "no", ""]


def test_a_narrowed_context_reads_the_same(spark):
    wide = Context(reference_date="2026-07-19")
    df = spark.createDataFrame([(t,) for t in MIXED], "text string")
    want = {r.text: r.reading for r in read(df, "text", wide).collect()}
    for texts in (MIXED, ["5 cm", "20㎡", ""], ["EUR 5", "about 5 kg", "3万"]):
        own = spark.createDataFrame([(t,) for t in texts], "text string")
        ctx = narrowed(own, "text", wide)
        assert {r.text: r.reading for r in read(own, "text", ctx).collect()} == {t: want[t] for t in texts}
    few = narrowed(spark.createDataFrame([("5 cm",)], "text string"), "text", wide)
    assert set(few.only) == {"registered", "date", "number"} and not (few.ranges or few.fuzzy or few.conversions)
