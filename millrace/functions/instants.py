"""One unambiguous instant from timestamps written in many forms.

An ordered cascade of anchored patterns splits the text into fields; a text that matches
none, or names a date or time that does not exist, has no instant.  The first pattern that
matches decides.
"""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZONE = r"(Z|z|UTC|GMT|BST|CEST|CET|EST|EDT|[+-]\d{2}:?\d{2}|[+-]\d{2})"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"([AaPp])\.?[Mm]\.?"
_DAY_NAME = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(" + "|".join(m[0].upper() + m[1:] for m in _MONTHS) + ")[a-z]*"

#: Fixed offsets of zone names, in minutes.
ZONE_MINUTES = {"Z": 0, "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240}


@dataclass(frozen=True)
class Form:
    """A written form: an anchored pattern and the group number of each part (0: absent)."""

    name: str
    pattern: str
    year: int = 0
    month: int = 0
    day: int = 0
    hour: int = 0
    minute: int = 0
    second: int = 0
    fraction: int = 0
    half: int = 0
    zone: int = 0


_TIME = rf"(?:\s+{_CLOCK}(?:\s*{_HALF})?(?:\s*{_ZONE})?)?"
FORMS = (
    Form("iso", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt\s]\s*(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?:\s*{_ZONE})?)?", 1, 2, 3, 4, 5, 6, 7, 0, 8),
    Form("basic", rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(?:\s*{_ZONE})?", 1, 2, 3, 4, 5, 6, 7, 0, 8),
    Form("year_slash", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_TIME}", 1, 2, 3, 4, 5, 6, 7, 8, 9),
    Form("slash", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}", 3, 2, 1, 4, 5, 6, 7, 8, 9),
    Form("dots", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TIME}", 3, 2, 1, 4, 5, 6, 7, 8, 9),
    Form("month_name", rf"(?i){_DAY_NAME}(\d{{1,2}})[\s-]{_MONTH}\.?,?[\s-](\d{{4}}){_TIME}", 3, 2, 1, 4, 5, 6, 7, 8, 9),
)
NUMBER_FORMS = {"unix_seconds": r"^\d{10}$", "unix_millis": r"^\d{13}$", "sheet_days": r"^\d{5}(\.\d+)?$"}
_FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone")
_US = 1_000_000


def _bare(column: str) -> Column:
    return F.regexp_replace(F.col(column), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a computed column that filters above it do not compute again: they cannot pass a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar that exists, else null."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    whole = lambda a, b: F.floor(a / F.lit(b)).cast("int")
    y = year - F.when(month <= 2, 1).otherwise(0)  # years begin in March
    in_year = whole(((month + 9) % 12) * 153 + 2, 5) + day - 1
    since = y * 365 + whole(y, 4) - whole(y, 100) + whole(y, 400) + in_year - 719468
    return F.when((year >= 1) & month.between(1, 12) & (day >= 1) & (day <= longest), since)


def _anchored(form: Form) -> str:
    flags = "(?i)" if form.pattern.startswith("(?i)") else ""
    return f"{flags}^{form.pattern.removeprefix('(?i)')}$"


def _form_of(text: Column) -> Column:
    """The name of the first form that matches, or null."""
    out = None
    for name, pattern in [*((f.name, _anchored(f)) for f in FORMS), *NUMBER_FORMS.items()]:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _parts_of(form: Column, text: Column) -> Column:
    """The parts of a text of a known form as one text, joined by bars, in the order of ``_FIELDS``."""
    out = None
    for f in FORMS:
        groups = "|".join(f"${getattr(f, x)}" if getattr(f, x) else "" for x in _FIELDS)
        taken = F.regexp_replace(text, _anchored(f), groups)
        out = F.when(form == f.name, taken) if out is None else out.when(form == f.name, taken)
    return out


def read_forms(df: DataFrame, column: str) -> DataFrame:
    """Add ``_form`` (the first form that matches, or null) and ``_p``, the struct of its parts.

    Each step is an operator of its own: one that held them all would make a method too large for
    the machine to compile.
    """
    split = _once(df.withColumn("_text", _bare(column)), "_form", _form_of(F.col("_text")))
    split = _once(split, "_parts", F.split(_parts_of(F.col("_form"), F.col("_text")), r"\|"))
    item = lambda k: F.nullif(F.col("_parts")[k], F.lit(""))
    number = lambda k: item(k).try_cast("int")
    month = F.coalesce(number(1), F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.left(item(1), F.lit(3)))).cast("int"), F.lit(0)))
    split = _once(split, "_month", month)
    month = F.col("_month")
    parts = F.struct(
        number(0).alias("year"), month.alias("month"), number(2).alias("day"), number(3).alias("hour"), number(4).alias("minute"),
        number(5).alias("second"), item(6).alias("fraction"), F.lower(item(7)).alias("half"), F.upper(item(8)).alias("zone"),
    )
    return _once(split, "_p", parts).drop("_parts", "_month")


def slash_orders(read: DataFrame, file_column: str) -> DataFrame:
    """``file_column`` and ``_month_first`` of each file with slash dates, from dates that show their order.

    A date shows its order where it exists when read in this order only, one of its numbers being
    above 12.  Should a file's dates show both orders, the one shown more often holds; files
    where neither is get null.
    """
    year, first, second = (F.col(f"_p.{x}") for x in ("year", "day", "month"))
    shows_day = (first > 12) & _days(year, second, first).isNotNull()
    shows_month = (second > 12) & _days(year, first, second).isNotNull()
    seen = read.where(F.col("_form") == "slash").groupBy(file_column).agg(F.count_if(shows_day).alias("_d"), F.count_if(shows_month).alias("_m"))
    return seen.select(F.col(file_column).alias("_order_file"), F.when(F.col("_d") != F.col("_m"), F.col("_m") > F.col("_d")).alias("_month_first"))


def valid_zones(zones: DataFrame, column: str) -> DataFrame:
    """Set zone names that no clock knows to null."""
    return zones.withColumn(column, F.when(F.col(column).isin(sorted(zoneinfo.available_timezones())), F.col(column)))


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.left(digits, F.lit(2)).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    written = F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))
    named = None
    for name, value in ZONE_MINUTES.items():
        named = F.when(zone == name, value) if named is None else named.when(zone == name, value)
    return F.when(zone.rlike("^[+-]"), written).otherwise(named)


def to_instants(read: DataFrame, zone_column: str, month_first_column: str, month_first_default: bool = False) -> DataFrame:
    """Add ``utc_micros`` (microseconds since 1970-01-01 UTC, or null) and ``clock_case``.

    ``read`` comes from ``read_forms``.  Absent parts are zero; digits beyond microseconds are
    cut off.  Without a written zone the zone in ``zone_column`` holds; where that is null, a
    local time has no instant.  A repeated local time means the earlier instant
    (``clock_case`` 'repeated'), a skipped one moves forward by the gap ('skipped'), all else
    is 'plain'.  Ten digits are Unix seconds, thirteen milliseconds, five digits spreadsheet
    days since 1899-12-30 in local time to the nearest second.  Slash dates take the order in
    ``month_first_column``, or the default where it is null.
    """
    p = lambda name: F.col(f"_p.{name}")
    swap = (F.col("_form") == "slash") & F.coalesce(F.col(month_first_column), F.lit(month_first_default))
    day, month = F.when(swap, p("month")).otherwise(p("day")), F.when(swap, p("day")).otherwise(p("month"))
    placed = _once(read, "_date", F.struct(p("year").alias("y"), month.alias("m"), day.alias("d")))
    placed = _once(placed, "_days", _days(F.col("_date.y"), F.col("_date.m"), F.col("_date.d")))
    half_hour = F.when(p("hour").between(1, 12), p("hour") % 12 + F.when(p("half") == "p", 12).otherwise(0))
    hour = F.when(p("half").isNotNull(), half_hour).otherwise(F.coalesce(p("hour"), F.lit(0)))
    clock = F.struct(hour.alias("h"), F.coalesce(p("minute"), F.lit(0)).alias("m"), F.coalesce(p("second"), F.lit(0)).alias("s"))
    placed = _once(placed, "_clock", clock)
    t = lambda name: F.col(f"_clock.{name}")
    fraction = F.rpad(F.left(F.coalesce(p("fraction"), F.lit("")), F.lit(6)), 6, "0").try_cast("bigint")
    sound = (t("h") <= 23) & (t("m") <= 59) & (t("s") <= 59)
    seconds = F.col("_days").cast("bigint") * 86400 + t("h") * 3600 + t("m") * 60 + t("s")
    written = F.when(sound, seconds * _US + fraction)
    sheet = F.round(F.when(F.col("_form") == "sheet_days", F.col("_text")).try_cast("decimal(38,18)") * 86400, 0).cast("bigint") - 25569 * 86400
    count = F.when(F.col("_form").isin("unix_seconds", "unix_millis"), F.col("_text")).try_cast("bigint")
    placed = _once(placed, "_local", F.when(F.col("_form") == "sheet_days", sheet * _US).otherwise(written))
    placed = _once(placed, "_offset", F.when(p("zone").isNotNull(), _offset_minutes(p("zone"))))
    placed = placed.withColumn("_zone", F.when(p("zone").isNull() & F.col("_local").isNotNull(), F.col(zone_column)))
    as_zone = lambda micros: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(micros), F.col("_zone")))
    back = lambda micros: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), F.col("_zone")))
    placed = _once(placed, "_site", F.when(F.col("_zone").isNotNull(), as_zone(F.col("_local"))))
    instant = (
        F.when(F.col("_form") == "unix_seconds", count * _US)
        .when(F.col("_form") == "unix_millis", count * 1000)
        .when(p("zone").isNotNull(), F.col("_local") - F.col("_offset").cast("bigint") * 60 * _US)
        .otherwise(F.col("_site"))
    )
    # the offset of a day later gives the other instant of a time that comes twice, however long the overlap is
    next_day = F.col("_site") + 86400 * _US
    later = F.col("_local") - (back(next_day) - next_day)
    twice = (later > F.col("_site")) & (back(later) == F.col("_local"))
    case = F.when(back(F.col("_site")) != F.col("_local"), "skipped").when(twice, "repeated").otherwise("plain")
    done = _once(placed, "utc_micros", instant)
    known = F.when(F.col("_site").isNotNull(), case).otherwise("plain")
    done = done.withColumn("clock_case", F.when(F.col("utc_micros").isNotNull(), known))
    return done.drop("_local", "_offset", "_zone", "_site", "_date", "_days", "_clock")


def normalise(df: DataFrame, column: str, file_column: str, zones: DataFrame, month_first_default: bool = False) -> DataFrame:
    """``df`` with ``form``, ``utc_micros`` and ``clock_case`` of the texts in ``column``.

    ``zones`` has one row per ``file_hash`` with its ``site_zone``.  Rows of files without a
    zone keep instants only where the text has its own zone.  Null, blank and unreadable texts
    give nulls; repeated rows stay repeated; an empty table stays empty.
    """
    read = read_forms(df, column)
    orders = slash_orders(read_forms(df.where(F.col(column).contains("/")).select(file_column, column), column), file_column)
    sites = zones.select(F.col("file_hash").alias("_zone_file"), F.col("site_zone").alias("_site_zone"))
    sited = read.join(sites, F.col(file_column) == F.col("_zone_file"), "left").drop("_zone_file")
    sited = sited.join(orders, F.col(file_column) == F.col("_order_file"), "left").drop("_order_file")
    done = to_instants(sited, "_site_zone", "_month_first", month_first_default)
    return done.select(*df.columns, F.col("_form").alias("form"), "utc_micros", "clock_case")


def file_zones(arrivals: DataFrame) -> DataFrame:
    """One zone per file: that of its earliest arrival with a known zone name."""
    known = valid_zones(arrivals.select("file_hash", "site_zone", "received_at", "intake_id"), "site_zone")
    known = known.where(F.col("file_hash").isNotNull() & F.col("site_zone").isNotNull())
    return known.groupBy("file_hash").agg(F.min_by("site_zone", F.struct("received_at", "intake_id")).alias("site_zone"))
