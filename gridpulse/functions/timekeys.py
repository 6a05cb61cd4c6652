"""Calendar keys. Weeks are ISO weeks and always travel with their ISO year."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full week in display order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_year(t: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(t))


def iso_week(t: Column | str) -> Column:
    return F.weekofyear(_col(t))


def week_label(t: Column | str) -> Column:
    """``2013_W47``"""
    return F.concat(iso_year(t).cast("string"), F.lit("_W"), F.lpad(iso_week(t).cast("string"), 2, "0"))


def week_number(t: Column | str) -> Column:
    """``201347``"""
    return iso_year(t) * 100 + iso_week(t)


def week_index(t: Column | str) -> Column:
    """UTC weeks since the Monday before 1970: plain arithmetic, so the cheap key to group rows by."""
    return F.floor((F.unix_seconds(_col(t).cast("timestamp")) + 259_200) / 604_800)


def index_monday(index: Column | str) -> Column:
    """The first day of a `week_index`."""
    return F.date_from_unix_date((_col(index) * 7 - 3).cast("int"))


def label_number(label: Column | str) -> Column:
    """``2013_W47`` to ``201347``; NULL for text that is no week label."""
    return F.replace(_col(label), F.lit("_W"), F.lit("")).try_cast("int")


def label_index(label: Column | str) -> Column:
    """``2013_W47`` to the `week_index` of that week; NULL for text that is no week label."""
    number = label_number(label)
    # The first ISO week of a year holds the fourth of January.
    first = F.floor((F.unix_date(F.make_date(F.floor(number / 100).cast("int"), F.lit(1), F.lit(4))) + 3) / 7)
    return F.when(number % 100 > 0, first + number % 100 - 1)


def week_start(index: int) -> str:
    """The UTC time at which a `week_index` begins, as text."""
    return (datetime(1970, 1, 1) + timedelta(days=index * 7 - 3)).isoformat(sep=" ")


def hour_of_day(t: Column | str) -> Column:
    return F.hour(_col(t))


def calendar_date(t: Column | str) -> Column:
    return F.to_date(_col(t))


def weekday_name(t: Column | str) -> Column:
    return F.date_format(_col(t), "EEEE")


def weekday_short(t: Column | str) -> Column:
    return F.dayname(_col(t))


def weekday_index(t: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(t))
