"""Expressions over 24-item hourly lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.schemas import OPEN_FROM, OPEN_HOURS, OPEN_TO


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(arr: Column | str) -> Column:
    """Sum of a list."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def count_flags(arr: Column | str) -> Column:
    return F.aggregate(_c(arr), F.lit(0), lambda acc, x: acc + x)


def open_hours(arr: Column | str) -> Column:
    return F.slice(_c(arr), OPEN_FROM + 1, OPEN_HOURS)


def empty_hours(flags: Column | str) -> Column:
    """Out-of-stock hours between opening and closing."""
    return count_flags(open_hours(flags))


def is_clean(flags: Column | str) -> Column:
    return empty_hours(flags) == 0


def first_empty_hour(flags: Column | str) -> Column:
    """Hour of day at which the shelf first runs empty; -1 if it never does."""
    at = F.array_position(open_hours(flags), 1).cast("int")
    return F.when(at > 0, at + (OPEN_FROM - 1)).otherwise(-1)


def last_empty_hour(flags: Column | str) -> Column:
    """The hour after the last empty one; -1 if there is none."""
    at = F.array_position(F.reverse(open_hours(flags)), 1).cast("int")
    return F.when(at > 0, (OPEN_TO + 1) - at).otherwise(-1)


def share_in_stock(profile: Column | str, flags: Column | str) -> Column:
    """Share of a normal day's demand that falls in the hours with stock."""
    return total(F.zip_with(_c(profile), _c(flags), lambda p, o: p * (1 - o)))


def hide(sales: Column | str, flags: Column | str) -> Column:
    """Sales with the flagged hours blanked out."""
    return F.zip_with(_c(sales), _c(flags), lambda s, o: s * (1 - o))


def flip(flags: Column | str) -> Column:
    return F.transform(_c(flags), lambda o: 1 - o)
