"""What grows with a table's rows: nothing that is sorted, grouped or held whole by a task."""

from datetime import datetime

from pyspark.sql import functions as F

from lectura.functions.numbers import number
from lectura.operators.read import Context, read
from lectura.operators.scan import scan


def test_scan_holds_distinct_candidates_only(spark):
    """Rows that tell apart only in what JSON leaves out, and repeated rows, keep their own values; no row is sorted for it."""
    at = [datetime(2026, 1, 1, 0, 0, 0, micro) for micro in (1, 2, 2)]
    docs = spark.createDataFrame([(t, "幅30mm、30 m2") for t in at], "at_ timestamp, note string")
    found = scan(docs, "note")
    rows = sorted((r["at_"], r["text"]) for r in found.select("at_", "text").collect())
    assert rows == sorted((t, text) for t in at for text in ("30mm", "30 m2"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    top = [line.strip(" :+-*") for line in plan.splitlines()]
    assert "ShuffledHashJoin" in plan and "BuildRight" in next(line for line in top if "Join" in line)


def test_a_text_that_is_not_asked_for_stays_out_of_the_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * 50) for i in range(20)], "id long, text string")
    told = read(docs, "text", Context(only=("number",), ranges=False, conversions=False, fuzzy=False)).select("id", "reading.code")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join") :].splitlines()[1]
    assert "md5" in left and " text#" not in left.replace("md5(cast(text#", "")


def test_ends_of_long_texts_are_still_read(spark):
    long = "0" * 400
    texts = {f"{long}5 EUR": 5.0, f"{long}7 dollars": 7.0, f"{long}9 pence": 0.09, f"{long}2 cents": 0.02, f"{long}3円": 3.0, f"{long}4 °C": 4.0, f"$ {long}6": 6.0}
    df = read(spark.createDataFrame([(t,) for t in texts], "text string"), "text", Context(only=("temperature", "currency", "number"), ranges=False, conversions=False, fuzzy=False))
    assert {r["text"]: round(r["value"], 6) for r in df.select("text", "reading.value").collect()} == texts
    numbers = {"1 234,5": 1234.5, "3億2万": 300020000.0, "二千三": 2003.0, "2½": 2.5, "twenty-one": 21.0, "1_000": 1000.0, "a.b": None, "5 x": None, "-1.5": -1.5, "1'000.5": 1000.5}
    got = spark.createDataFrame([(t,) for t in numbers], "text string").select("text", number(F.col("text")).alias("n")).collect()
    assert {r["text"]: r["n"] for r in got} == numbers
