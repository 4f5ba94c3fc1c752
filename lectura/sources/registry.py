"""The unit registry as dimension tables: units, and the spellings that name them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit, canonical unit, dimension, factor to the canonical unit, spellings.
# In spellings (s) stands for a singular and a plural, and "meter" or "liter" also for "metre" or "litre"; _ is a space.
UNITS = """
m        | m      | length        | 1.0                  | m meter(s) metro(s) mètre(s) 米
km       | m      | length        | 1000.0               | km kilometer(s) klick(s) kilómetro(s) kilometro(s) quilômetro(s) quilometro(s) 公里
cm       | m      | length        | 0.01                 | cm centimeter(s)
mm       | m      | length        | 0.001                | mm millimeter(s)
μm       | m      | length        | 0.000001             | μm µm um micron(s) micrometer(s)
in       | m      | length        | 0.0254               | in inch inches \" '' ″
ft       | m      | length        | 0.3048               | ft ft. foot feet ' ′
yd       | m      | length        | 0.9144               | yd yard(s)
mi       | m      | length        | 1609.344             | mi mile(s)
nmi      | m      | length        | 1852.0               | nmi nautical_mile(s)
hand     | m      | length        | 0.1016               | hand(s)
thou     | m      | length        | 0.0000254            | thou mil(s)
ly       | m      | length        | 9460730472580800.0   | ly light_year(s)
fathom   | m      | length        | 1.8288               | fathom(s)
kg       | kg     | mass          | 1.0                  | kg kilogram(s) kilogramme(s) kilo(s) 公斤 千克 キログラム キロ kilogramo(s) quilograma(s)
g        | kg     | mass          | 0.001                | g gram(s)
lb       | kg     | mass          | 0.45359237           | lb lbs pound(s) #
oz       | kg     | mass          | 0.028349523125       | oz ounce(s)
st       | kg     | mass          | 6.35029318           | st stone(s)
gr       | kg     | mass          | 0.00006479891        | gr grain(s)
troy oz  | kg     | mass          | 0.0311034768         | troy_oz troy_ounce(s)
ct       | kg     | mass          | 0.0002               | ct carat(s)
mcg      | kg     | mass          | 0.000000001          | mcg μg µg ug microgram(s)
t        | kg     | mass          | 1000.0               | t tonne(s) metric_ton(s)
s        | s      | time          | 1.0                  | s sec(s) second(s)
min      | s      | time          | 60.0                 | min min(s) minute(s) minuto(s) 分钟
h        | s      | time          | 3600.0               | h hr(s) hour(s) hora(s) heure(s) 時間 小时
day      | s      | time          | 86400.0              | d day(s) 日
week     | s      | time          | 604800.0             | week(s)
fortnight| s      | time          | 1209600.0            | fortnight(s)
month    | s      | time          | 2629746.0            | month(s)
year     | s      | time          | 31556952.0           | year(s) yr(s)
m2       | m2     | area          | 1.0                  | m2 m^2 m² ㎡ sqm square_meter(s) 平米 平方メートル metro(s)_cuadrado(s) mètre(s)_carré(s) metre(s)_carre(s) metro(s)_quadrado(s) 平方米
ft2      | m2     | area          | 0.09290304           | ft2 ft^2 ft² sq_ft sqft square_foot square_feet
acre     | m2     | area          | 4046.8564224         | acre(s)
ha       | m2     | area          | 10000.0              | ha hectare(s)
L        | L      | volume        | 1.0                  | L l liter(s) litro(s) 升
mL       | L      | volume        | 0.001                | mL ml milliliter(s)
cc       | L      | volume        | 0.001                | cc
m3       | L      | volume        | 1000.0               | m3 m^3 m³ cbm cubic_meter(s)
tbsp     | L      | volume        | 0.01478676478125     | tbsp tablespoon(s)
tsp      | L      | volume        | 0.00492892159375     | tsp teaspoon(s)
fl oz    | L      | volume        | 0.0295735295625      | fl_oz fl._oz. fluid_ounce(s)
pt       | L      | volume        | 0.473176473          | pt pint(s)
qt       | L      | volume        | 0.946352946          | qt quart(s)
gal      | L      | volume        | 3.785411784          | gal gallon(s)
m/s      | m/s    | speed         | 1.0                  | m/s mps meter(s)_per_second
km/h     | m/s    | speed         | 1000.0/3600.0        | km/h kph kmh kilometer(s)_per_hour
mph      | m/s    | speed         | 1609.344/3600.0      | mph mile(s)_per_hour
kn       | m/s    | speed         | 1852.0/3600.0        | kn knot(s)
B        | B      | data          | 1.0                  | B byte(s)
bit      | B      | data          | 0.125                | bit(s) b
kB       | B      | data          | 1000.0               | kB KB kilobyte(s)
MB       | B      | data          | 1000000.0            | MB megabyte(s)
GB       | B      | data          | 1000000000.0         | GB gigabyte(s) gig(s)
TB       | B      | data          | 1000000000000.0      | TB terabyte(s)
Mbit     | B      | data          | 125000.0             | Mbit Mb megabit(s)
TiB      | B      | data          | 1099511627776.0      | TiB tebibyte(s)
Mbit/s   | bit/s  | data_rate     | 1000000.0            | Mbit/s Mbps mbps Mb/s megabit(s)_per_second
kbit/s   | bit/s  | data_rate     | 1000.0               | kbit/s kbps Kbps kb/s Kb/s kilobit(s)/s
Gbit/s   | bit/s  | data_rate     | 1000000000.0         | Gbit/s Gbps gbps Gb/s gigabit(s)_per_second
bit/s    | bit/s  | data_rate     | 1.0                  | bit(s)/s bit(s)/sec b/s
MB/s     | bit/s  | data_rate     | 8000000.0            | MB/s MBps megabyte(s)_per_second
MiB/s    | bit/s  | data_rate     | 8388608.0            | MiB/s MiBps mebibyte(s)_per_second
m3/s     | m3/s   | flow_rate     | 1.0                  | m3/s m^3/s m³/s cubic_meter(s)_per_second
m3/h     | m3/s   | flow_rate     | 1.0/3600.0           | m3/h m^3/h m³/h m3_per_hour m^3_per_hour
L/s      | m3/s   | flow_rate     | 0.001                | L/s l/s liter(s)_per_second
L/min    | m3/s   | flow_rate     | 0.001/60.0           | L/min l/min lpm liter(s)_per_minute
mL/min   | m3/s   | flow_rate     | 0.000001/60.0        | mL/min ml/min mL_per_minute ml_per_minute cc/min cc_per_minute
gpm      | m3/s   | flow_rate     | 0.003785411784/60.0  | gpm gal/min gallon(s)_per_minute
cfm      | m3/s   | flow_rate     | 0.028316846592/60.0  | cfm ft3/min ft^3/min cubic_feet_per_minute
mol/m3   | mol/m3 | concentration | 1.0                  | mol/m3 mol/m^3 mol/m³ mole(s)_per_cubic_meter
μM       | mol/m3 | concentration | 0.001                | μM µM uM micromolar
mM       | mol/m3 | concentration | 1.0                  | mM millimolar
m/s2     | m/s2   | acceleration  | 1.0                  | m/s2 m/s^2 m/s² meter(s)_per_second_squared
g0       | m/s2   | acceleration  | 9.80665              | g0 gee(s)
N        | N      | force         | 1.0                  | N newton(s)
kgf      | N      | force         | 9.80665              | kgf kilogram_force kilogram-force
lbf      | N      | force         | 4.4482216152605      | lbf pound_force pound-force
N*m      | N*m    | torque        | 1.0                  | N*m N_m N·m N⋅m Nm newton_meter(s)
lbf*ft   | N*m    | torque        | 4.4482216152605*0.3048 | lbf*ft lbf_ft lbf·ft lb-ft pound_force_foot
Pa       | Pa     | pressure      | 1.0                  | Pa pascal(s)
kPa      | Pa     | pressure      | 1000.0               | kPa kilopascal(s)
psi      | Pa     | pressure      | 6894.757293168       | psi pound(s)_per_square_inch
inH2O    | Pa     | pressure      | 249.08891            | inH2O inH₂O in_H2O in_water iwc
kgf/cm2  | Pa     | pressure      | 98066.5              | kgf/cm2 kgf/cm^2 kgf/cm² kgf_per_square_centimeter
W        | W      | power         | 1.0                  | W watt(s)
hp       | W      | power         | 745.699872           | hp horsepower mechanical_horsepower
V        | V      | voltage       | 1.0                  | V volt(s)
A        | A      | current       | 1.0                  | A amp(s) ampere(s)
mA       | A      | current       | 0.001                | mA milliamp(s) milliampere(s)
Ω        | Ω      | resistance    | 1.0                  | Ω ohm(s)
C        | C      | charge        | 1.0                  | coulomb(s)
mAh      | C      | charge        | 3.6                  | mAh mah milliamp_hour(s) milliampere_hour(s)
lx       | lx     | illuminance   | 1.0                  | lx lux
fc       | lx     | illuminance   | 10.763910416709722   | fc foot-candle(s) foot_candle(s)
Sv       | Sv     | radiation_equivalent_dose | 1.0      | Sv sievert(s)
mSv      | Sv     | radiation_equivalent_dose | 0.001    | mSv millisievert(s)
Bq       | Bq     | radioactivity | 1.0                  | Bq becquerel(s)
MBq      | Bq     | radioactivity | 1000000.0            | MBq megabecquerel(s)
"""
#: Units whose factor is only conventional.
APPROXIMATE = {"month", "year"}


def _factor(text: str) -> float:
    """A number, a product or a quotient of two."""
    left, op, right = re.match(r"([0-9.]+)(?:([*/])([0-9.]+))?$", text).groups()
    return float(left) if op is None else float(left) * float(right) if op == "*" else float(left) / float(right)


def _spellings(pattern: str) -> list[str]:
    forms = [pattern.replace("(s)", ""), pattern.replace("(s)", "s")]
    forms += [f.replace("meter", "metre").replace("liter", "litre") for f in forms if "meter" in f or "liter" in f]
    return [f.replace("_", " ").replace('\\"', '"') for f in dict.fromkeys(forms)]


def _rows() -> list[tuple]:
    rows = []
    for pos, line in enumerate(UNITS.strip().splitlines()):
        unit, canonical, dimension, factor, names = (x.strip() for x in line.split("|"))
        aliases = list(dict.fromkeys([a for n in names.split(" ") if n for a in _spellings(n)] + ([unit] if unit != "C" else [])))
        rows.append((pos, unit, canonical, dimension, _factor(factor), unit in APPROXIMATE, aliases))
    return rows


ROWS = _rows()
FACTORS = {unit: (canonical, dimension, factor) for _, unit, canonical, dimension, factor, _, _ in ROWS}


def units(spark: SparkSession) -> DataFrame:
    """A row per unit, in the order in which they match."""
    return spark.createDataFrame(ROWS, "pos int, unit string, canonical string, dimension string, factor double, approximate boolean, aliases array<string>")


def units_of(spark: SparkSession, dimension: str) -> DataFrame:
    return units(spark).filter(F.col("dimension") == dimension)


def aliases(spark: SparkSession, custom: DataFrame | None = None, dimensions: list[str] | None = None) -> DataFrame:
    """alias, exact (or any case), and the unit it names: some 800 rows, plus those of `custom` (of the columns of units()).

    A spelling without capitals, all ASCII, also matches in any case; registered units come before custom ones.
    """
    spelled = units(spark)
    if custom is not None:
        spelled = spelled.unionByName(custom.withColumn("pos", F.col("pos") + 1_000_000))
    if dimensions is not None:
        spelled = spelled.filter(F.col("dimension").isin(dimensions))
    each = spelled.withColumn("alias", F.explode("aliases")).drop("aliases")
    plain = each.filter(~F.col("alias").rlike(r"[^\x00-\x7F]|[A-Z]")).withColumn("exact", F.lit(False))
    both = each.withColumn("exact", F.lit(True)).unionByName(plain)
    return both.groupBy("alias", "exact").agg(F.min(F.struct("pos", "unit", "canonical", "dimension", "factor", "approximate")).alias("u"))
