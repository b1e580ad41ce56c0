"""The Solar Hijri calendar as Column expressions, by the arithmetic rule of 33 years with eight leap years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import persian_digits

#: Days from the calendar's first day to 1970-01-01, and the names of its months.
EPOCH = 492_268
MONTHS = ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند"]


def _before(year: Column) -> Column:
    """Days before a year's first."""
    return 365 * (year - 1) + F.floor((8 * year + 21) / 33)


def is_leap(year: Column) -> Column:
    return _before(year + 1) - _before(year) == 366


def solar_hijri(date: Column) -> Column:
    """struct(year, month, day) of a date."""
    days = F.datediff(date, F.lit("1970-01-01").cast("date")) + EPOCH
    year = F.floor((33 * days + 3) / 12053) + 1
    of_year = days - _before(year)
    month = F.when(of_year < 186, F.floor(of_year / 31)).otherwise(F.floor((of_year - 6) / 30))
    day = of_year - F.when(month < 6, month * 31).otherwise(month * 30 + 6) + 1
    return F.struct(year.cast("int").alias("year"), (month + 1).cast("int").alias("month"), day.cast("int").alias("day"))


def from_solar_hijri(year: Column, month: Column, day: Column) -> Column:
    """The date, or null for a day that the calendar doesn't have."""
    n = _before(year) + F.when(month <= 6, (month - 1) * 31).otherwise((month - 1) * 30 + 6) + day - 1 - EPOCH
    last = F.when(month <= 6, 31).when((month < 12) | is_leap(year), 30).otherwise(29)
    return F.when(month.between(1, 12) & day.between(1, last), F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")))


def said_date(at: Column) -> Column:
    """Day, month's name, year, hour and minute in Persian digits, as a history list shows them."""
    d = solar_hijri(F.to_date(at))
    name = F.get(F.array(*map(F.lit, MONTHS)), d["month"] - 1)
    return persian_digits(F.concat(d["day"].cast("string"), F.lit(" "), name, F.lit(" "), d["year"].cast("string"), F.lit("،‏ "), F.date_format(at, "H:mm")))
