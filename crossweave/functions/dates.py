"""Weeks, local days and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The local time zone of reviews and date filters.
LOCAL_ZONE = "Asia/Seoul"


def iso_week(ts: Column | str) -> Column:
    """'YYYY-Www' of a timestamp by its ISO year, null for null."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.when(ts.isNotNull(), F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")))


def local_date(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def parse_time(text: Column | str) -> Column:
    """ISO strings with Z, an offset or none (UTC) as timestamps; null for anything else."""
    return F.try_to_timestamp(text)


def week_monday(week: Column | str) -> Column:
    """Monday of an ISO week 'YYYY-Www'; null where the text is no week that its year has."""
    week = F.col(week) if isinstance(week, str) else week
    fits = week.rlike(r"^\d{4}-W\d{2}$")
    year = F.when(fits, F.substring(week, 1, 4).cast("int"))
    number = F.when(fits, F.substring(week, 7, 2).cast("int"))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number - 1) * 7)
    return F.when((number >= 1) & (number <= 53) & (iso_week(monday) == week), monday)


def week_thursday(week: Column | str) -> Column:
    return F.date_add(week_monday(week), 3)


def week_month(week: Column | str) -> Column:
    """The month 'YYYY-MM' that a week belongs to, that of its Thursday."""
    return F.date_format(week_thursday(week), "yyyy-MM")


def previous_weeks(week: Column | str, n: int) -> Column:
    """The n weeks before, latest first, as an array; empty where the text is no week."""
    monday = week_monday(week)
    weeks = F.array(*[iso_week(F.date_sub(monday, 7 * k)) for k in range(1, n + 1)]) if n else F.array().cast("array<string>")
    return F.when(monday.isNotNull(), weeks).otherwise(F.array().cast("array<string>"))


def week_label(week: Column | str) -> Column:
    """A reader's name of the week, 'Y년 M월 k주차', by its Thursday; other texts as they are."""
    week = F.col(week) if isinstance(week, str) else week
    thursday = week_thursday(week)
    name = F.format_string("%d년 %d월 %d주차", F.year(thursday), F.month(thursday), F.floor((F.dayofmonth(thursday) - 1) / 7).cast("int") + 1)
    return F.when(thursday.isNotNull(), name).otherwise(week)
