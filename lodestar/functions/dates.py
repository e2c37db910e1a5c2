"""Partial dates: `YYYY`, `YYYY-MM` or `YYYY-MM-DD`, whose precision is never raised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?"


def _part(text: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), _PARTS, k), F.lit("")).cast("int")


def year_fraction(text: Column) -> Column:
    """A year with its fraction; a month alone is taken at its 15th day, a year alone at its middle."""
    year, month, day = (_part(text, k) for k in (1, 2, 3))
    m, d = F.least(F.lit(12), F.greatest(F.lit(1), month)), F.least(F.lit(28), F.greatest(F.lit(1), F.coalesce(day, F.lit(15))))
    within = F.when(month.isNull(), year + 0.5).otherwise(year + ((m - 1) + (d - 1) / F.lit(30.0)) / F.lit(12.0))
    return F.when(year.between(1500, 2200), within)


def year_fraction_by_month(text: Column) -> Column:
    """The probe's variant: whole months only, July where there is none."""
    year, month = _part(text, 1), _part(text, 2)
    return F.when(year.isNotNull(), year + (F.coalesce(month, F.lit(7)) - 1) / F.lit(12.0))


def precision(text: Column) -> Column:
    """Day, month, year or blank, from the shape."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(t.rlike(r"^\d{4}-\d{2}$"), "month").when(t.rlike(r"^\d{4}$"), "year").otherwise("")


def compose(year: Column, month: Column, day: Column) -> Column:
    """The most precise date of which all earlier parts are there."""
    y = F.format_string("%04d", year)
    ym = F.format_string("%04d-%02d", year, month)
    return F.when(year.isNull(), None).when(month.isNull(), y).when(day.isNull(), ym).otherwise(F.format_string("%04d-%02d-%02d", year, month, day))


def bounds(text: Column) -> tuple[Column, Column]:
    """First and last day a partial date can mean; null if it is none."""
    t, kind = F.trim(text), precision(text)
    low = F.try_to_date(F.when(kind == "day", t).when(kind == "month", F.concat(t, F.lit("-01"))).when(kind == "year", F.concat(t, F.lit("-01-01"))), "yyyy-MM-dd")
    high = F.when(kind == "day", low).when(kind == "month", F.last_day(low)).when(kind == "year", F.date_add(F.add_months(low, 12), -1))
    return low, high


def overlaps(text: Column, start: str, end: str) -> Column:
    """Whether a partial date can lie in a window."""
    low, high = bounds(text)
    return (low <= F.lit(end).cast("date")) & (high >= F.lit(start).cast("date"))


def middle(start: Column, end: Column) -> Column:
    """The day that halves a window."""
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def decay(published: Column, as_of: float, half_life: Column | float) -> Column:
    """2 to the power of minus age over half-life; a future date has no age."""
    life = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), F.lit(float(as_of)) - published) / life)


def split_at(text: Column, kind: Column, month: str) -> Column:
    """Before or from a month, `unknown` where the precision leaves it open."""
    y, at = F.substring(F.trim(text), 1, 4), F.lit(month)
    return (
        F.when(kind.isin("day", "month"), F.when(F.substring(F.trim(text), 1, 7) < at, "pre").otherwise("post"))
        .when(kind == "year", F.when(y < at.substr(1, 4), "pre").when(y > at.substr(1, 4), "post").otherwise("unknown"))
        .otherwise("unknown")
    )
