"""Dates and local time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Santiago"


def local_trunc(unit: str, ts: Column, zone: str = ZONE) -> Column:
    """The start of a local day, month, ... as an instant."""
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone)


def day_month_year(c: Column, latest_year: int = 2100) -> Column:
    """dd/mm/yyyy or dd-mm-yyyy, or a bare year as its first day; implausible ones are null (a 31 February too)."""
    d, m, y = (F.regexp_extract(c, "^ *([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}) *$", k).try_cast("int") for k in (1, 2, 3))
    bare = F.regexp_extract(c, "^ *([0-9]{4}) *$", 1).try_cast("int")
    year = F.coalesce(y, bare)
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1))), "yyyy-MM-dd")
    return F.when(year.between(1900, latest_year), made)


def loose_date(c: Column) -> Column:
    """d/m/y anywhere in a text, a five-digit year repaired by dropping its second digit; else the first year 19xx or 20xx."""
    pattern = "([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4,5})"
    d, m, y = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    y = F.when(F.length(y) == 5, F.concat(F.substring(y, 1, 1), F.substring(y, 3, 3))).otherwise(y)
    whole = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    year = F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1)
    return F.coalesce(F.when(d != "", whole), F.when(year != "", F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")))


def strict_iso(c: Column) -> Column:
    """A yyyy-mm-dd that names a day of the calendar."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def iso_week(ts: Column) -> Column:
    """yyyy-Www, by the week's Thursday."""
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("week"), ts).cast("string"), 2, "0"))


def nice_ceiling(x: Column) -> Column:
    """The least 1, 2 or 5 times a power of ten that is not below x."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x <= 0, 1.0).when(x <= power, power).when(x <= 2 * power, 2 * power).when(x <= 5 * power, 5 * power).otherwise(10 * power)
