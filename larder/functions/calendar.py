"""Calendar columns. Each takes a DATE column, or a lambda variable inside `transform`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.tables import CALENDAR_FEATURES


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_annual(day: Column, month: int, day_of_month: int) -> Column:
    return ((F.month(day) == month) & (F.dayofmonth(day) == day_of_month)).cast("int")


def is_fourth_thursday_of_november(day: Column) -> Column:
    in_fourth_week = F.dayofmonth(day).between(22, 28)
    return ((F.month(day) == 11) & (weekday(day) == 3) & in_fourth_week).cast("int")


def calendar_features(day: Column) -> dict[str, Column]:
    """The calendar part of the model's inputs, in model order."""
    columns = (
        weekday(day),
        F.month(day),
        (weekday(day) >= 5).cast("int"),
        is_annual(day, 12, 25),
        is_annual(day, 7, 4),
        is_annual(day, 3, 14),
        is_fourth_thursday_of_november(day),
    )
    return dict(zip(CALENDAR_FEATURES, columns, strict=True))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def date_text(day: Column) -> Column:
    return day.cast("string")
