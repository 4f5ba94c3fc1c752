"""Clock times, durations and dates as column expressions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number
from .readings import quantity, reading
from .text import let

# Offsets of zone abbreviations, in hours.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "BST": 1, "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11}
# The names of the days of the week.
WEEKDAYS = {
    "MON": "monday mon lunes lundi segunda-feira segunda 月曜日 月曜 月 周一 星期一 一",
    "TUE": "tuesday tue tues martes mardi terça-feira terca-feira terça terca 火曜日 火曜 火 周二 星期二 二",
    "WED": "wednesday wed miércoles miercoles mercredi quarta-feira quarta 水曜日 水曜 水 周三 星期三 三",
    "THU": "thursday thu thur thurs jueves jeudi quinta-feira quinta 木曜日 木曜 木 周四 星期四 四",
    "FRI": "friday fri viernes vendredi sexta-feira sexta 金曜日 金曜 金 周五 星期五 五",
    "SAT": "saturday sat sábado sabado samedi 土曜日 土曜 土 周六 星期六 六",
    "SUN": "sunday sun domingo dimanche 日曜日 日曜 日 周日 星期日 星期天 天",
}
# Words for days by their distance from the reference date, and phrases around the name of a weekday.
DAYS = {"today": 0, "今日": 0, "tomorrow": 1, "mañana": 1, "demain": 1, "amanhã": 1, "明天": 1, "明日": 1, "yesterday": -1, "昨日": -1, "昨天": -1, "pasado mañana": 2, "明後日": 2, "后天": 2, "後天": 2, "一昨日": -2, "前天": -2}
NEXT, THIS, LAST = r"^(?:next |来週|下周)(.+)$|^(.+)(?: prochain| que vem)$", r"^(?:this |今週)(.+)$", r"^(?:last |先週)(.+)$"
#: Names of regions that a clock time can carry.
REGION = r"^[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)+$"
LAST_WORD = r"^(.+) (\S+)$"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double")


def clock_seconds(text: Column) -> Column:
    """Seconds of the day of 3pm, 3:05 pm, 14:30, 14:30:15, noon, midnight, 午後3時半."""
    twelve, day, ja = r"(?i)^([0-9]{1,2})(?::([0-9]{2}))?(?::([0-9]{2}))? ?([ap])\.?m\.?$", r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$", r"^(午前|午後)?([0-9]{1,2})時(?:([0-9]{1,2})分|(半))?$"
    seconds = lambda h, m, s: F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)
    z = F.lit(0.0)
    pm = F.lower(F.regexp_extract(text, twelve, 4)) == "p"
    h12 = _group(text, twelve, 1)
    hja = _group(text, ja, 2)
    half = F.when(F.regexp_extract(text, ja, 4) == "半", 30.0).otherwise(F.coalesce(_group(text, ja, 3), z))
    return (
        F.when(F.lower(text) == "noon", 43200.0)
        .when(F.lower(text) == "midnight", 0.0)
        .when(text.rlike(twelve) & h12.between(1, 12), seconds(h12 % 12 + F.when(pm, 12.0).otherwise(0.0), F.coalesce(_group(text, twelve, 2), z), F.coalesce(_group(text, twelve, 3), z)))
        .when(text.rlike(day) & (_group(text, day, 1) < 24), seconds(_group(text, day, 1), _group(text, day, 2), F.coalesce(_group(text, day, 3), z)))
        .when(text.rlike(ja) & (hja <= 24), seconds(F.when(F.regexp_extract(text, ja, 1) == "午後", hja % 12 + 12).otherwise(hja), half, z))
    )


def clock(text: Column) -> Column:
    return quantity(clock_seconds(text), "s", "time", 0.92)


def zone_seconds(zone: Column) -> Column:
    """The offset of an abbreviation or of UTC±h[:mm]."""
    shape = r"^(?:UTC|GMT)([+-])([0-9]{1,2})(?::([0-9]{2}))?$"
    named = F.try_element_at(F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v * 3600.0)]), zone)
    hours, minutes = _group(zone, shape, 2), F.coalesce(_group(zone, shape, 3), F.lit(0.0))
    sign = F.when(F.regexp_extract(zone, shape, 1) == "-", -1.0).otherwise(1.0)
    return F.coalesce(named, F.when((hours <= 23) & (minutes <= 59), sign * (hours * 3600 + minutes * 60)))


def region_seconds(zone: Column, seconds: Column, reference: Column) -> Column:
    """The offset that the zone database gives a region at that wall clock on the reference date."""
    wall = F.timestamp_seconds(F.unix_date(reference) * 86400 + F.floor(seconds))
    there = zone.isin(*sorted(z for z in available_timezones() if "/" in z))
    return F.when(there & reference.isNotNull(), (F.unix_seconds(wall) - F.unix_seconds(F.to_utc_timestamp(wall, zone))).cast("double"))


def zoned_clock(text: Column, reference: Column | None = None) -> Column:
    """A clock time with a zone, as seconds of the day in UTC; approximate where the day shifts. A region needs a reference date."""
    reference = F.lit(None).cast("date") if reference is None else reference
    zone = F.regexp_extract(text, LAST_WORD, 2)
    shifts = lambda x: (x < 0) | (x >= 86400)
    told = lambda x: quantity(F.pmod(x, F.lit(86400.0)), "s", "time", 0.90, approximate=shifts(x), code=F.when(shifts(x), "APPROXIMATION"), timezone="UTC")
    return let(clock_seconds(F.regexp_extract(text, LAST_WORD, 1)), lambda at: let(at - F.coalesce(zone_seconds(zone), region_seconds(zone, at, reference)), told))


def unsupported_zone(text: Column) -> Column:
    """A clock time with a region that can't be resolved is refused, not read without it."""
    known = clock_seconds(F.regexp_extract(text, LAST_WORD, 1)).isNotNull() & F.regexp_extract(text, LAST_WORD, 2).rlike(REGION)
    return reading("refused", known, code="TIMEZONE_UNSUPPORTED")


def duration_seconds(text: Column) -> Column:
    """ISO 8601 (weeks, days and times), 2d4h30m, 1h30 (minutes after h), and words such as 1 hour and 30 minutes."""
    iso = r"^P(?=[0-9T])(?:([0-9.]+)W)?(?:([0-9.]+)D)?(?:T(?:([0-9.]+)H)?(?:([0-9.]+)M)?(?:([0-9.]+)S)?)?$"
    compact = r"(?i)^(?=[0-9])(?:([0-9.]+)w)?(?:([0-9.]+)d)?(?:([0-9.]+)h)?(?:([0-9.]+)(?:min|m)|(?<=h)([0-9]+))?(?:([0-9.]+)s)?$"
    words = r"(?i)^(?:([0-9.]+) ?(?:hours?|hrs?|時間))(?:,? (?:and )?| ?)(?:([0-9.]+) ?(?:minutes?|mins?|分))$"
    total = lambda p, scale: sum((F.coalesce(_group(text, p, i), F.lit(0.0)) * f for i, f in scale), F.lit(0.0))
    return (
        F.when(F.lower(text).isin("an hour and a half", "one hour and a half"), 5400.0)
        .when(text.rlike(iso) & text.rlike("[0-9]") & ~text.endswith("T"), total(iso, ((1, 604800), (2, 86400), (3, 3600), (4, 60), (5, 1))))
        .when(text.rlike(words), total(words, ((1, 3600), (2, 60))))
        .when(text.rlike(compact) & text.rlike("(?i)[0-9][wdh].*|[0-9]m[0-9]+s"), total(compact, ((1, 604800), (2, 86400), (3, 3600), (4, 60), (5, 60), (6, 1))))
    )


def duration(text: Column) -> Column:
    return quantity(duration_seconds(text), "s", "time", 0.96)


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """The date where the calendar has it."""
    d = F.try_to_date(F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int")), "yyyy-MM-dd")
    return F.date_format(d, "yyyy-MM-dd")


def relative_date(text: Column, reference: Column) -> Column:
    """Days and weekdays counted from a reference date, N days ahead or back, and ISO dates. Without a reference nothing reads.

    The next weekday is the first after the reference, the last one the last before it, this one the first from it on.
    """
    low = F.lower(text)
    shift = F.try_element_at(F.create_map(*[F.lit(x) for k, v in DAYS.items() for x in (k, v)]), low)
    ahead = r"^(?:in ([0-9]{1,6}) days?|([0-9]{1,6})日後)$"
    back = r"^(?:([0-9]{1,6}) days? ago|([0-9]{1,6})日前)$"
    count = lambda p: F.coalesce(_group(low, p, 1), _group(low, p, 2)).cast("int")
    names = F.create_map(*[F.lit(x) for code, all_ in WEEKDAYS.items() for name in all_.split(" ") for x in (name, code)])
    weekday = lambda p, *groups: F.try_element_at(names, F.trim(F.coalesce(*[F.nullif(F.regexp_extract(low, p, g), F.lit("")) for g in groups])))
    after = lambda date, day: F.call_function("next_day", date, day)
    out = F.coalesce(
        F.date_add(reference, shift),
        F.when(low.rlike(ahead), F.date_add(reference, count(ahead))),
        F.when(low.rlike(back), F.date_add(reference, -count(back))),
        after(reference, weekday(NEXT, 1, 2)),
        after(F.date_sub(reference, 1), weekday(THIS, 1)),
        after(F.date_sub(reference, 8), weekday(LAST, 1)),
    )
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    written = iso_date(*[F.regexp_extract(text, iso, i) for i in (1, 2, 3)])
    date = F.coalesce(F.date_format(out, "yyyy-MM-dd"), F.when(text.rlike(iso) & reference.isNotNull(), written))
    return let(date, lambda d: reading("date", d.isNotNull(), date=d, confidence=0.98))


def slash_fraction(text: Column, reference: Column, locale: str | None, num=number) -> Column:
    """a/b as a fraction where it could also be a day of the reference's year: the dates are the other readings."""
    shape = r"^([^/]+)/([^/]+)$"
    a, b = num(F.regexp_extract(text, shape, 1)), num(F.regexp_extract(text, shape, 2))
    whole = lambda x: F.when((x == F.floor(x)) & x.between(1, 31), x.cast("int").cast("string"))
    year = F.year(reference).cast("string")
    orders = [iso_date(year, whole(a), whole(b)), iso_date(year, whole(b), whole(a))]
    dates = F.array_distinct(F.array_compact(F.array(*(orders[::-1] if locale == "en-GB" else orders))))
    told = lambda d: reading("number", (F.size(d) > 0) & (b != 0), value=a / b, confidence=0.55, code="AMBIGUOUS_DATE", dates=d)
    return F.when(text.rlike(shape), let(dates, told))


def slash_dates(text: Column, locale: str | None = None) -> tuple[Column, Column]:
    """Both calendar readings of a/b/yyyy: month first, then day first (the other way round for en-GB)."""
    shape = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    a, b, y = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    month_first, day_first = iso_date(y, a, b), iso_date(y, b, a)
    pair = (day_first, month_first) if locale == "en-GB" else (month_first, day_first)
    return tuple(F.when(text.rlike(shape), d) for d in pair)


def slash_date(text: Column, locale: str | None = None) -> Column:
    first, second = slash_dates(text, locale)
    return let(first, lambda a: let(second, lambda b: _either(a, b)))


def _either(first: Column, second: Column) -> Column:
    ambiguous = first.isNotNull() & second.isNotNull() & (first != second)
    return reading("date", first.isNotNull() | second.isNotNull(), date=F.coalesce(first, second), confidence=F.when(ambiguous, 0.94).otherwise(0.95), code=F.when(ambiguous, "AMBIGUOUS_DATE"))
