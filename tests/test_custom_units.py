"""A caller's own units, few and many."""

from lectura.operators import read as module
from lectura.operators.read import Context, read

UNITS = "unit string, canonical string, dimension string, factor double, approximate boolean, aliases array<string>"


def test_custom_units_by_broadcast_and_by_shuffle(spark, monkeypatch):
    custom = spark.createDataFrame([("smoot", "m", "length", 1.7018, False, ["smoot", "smoots"]), ("kg", "m", "length", 9.0, False, ["kg"])], UNITS).selectExpr("0 AS pos", "*")
    df = spark.createDataFrame([("2 smoots",), ("3 kg",), ("4 SMOOT",)], "text string")
    ctx = Context(only=("registered",), ranges=False, conversions=False, fuzzy=False)
    for most in (100_000, 0):
        monkeypatch.setattr(module, "BROADCAST_TERMS", most)
        got = {r.text: (r.reading.value, r.reading.unit) for r in read(df, "text", ctx, custom).collect()}
        assert got == {"2 smoots": (3.4036, "m"), "3 kg": (3.0, "kg"), "4 SMOOT": (6.8072, "m")}
