"""Calendar buckets for trend analyses (tumbling day/week/month/quarter/year)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_key(date_text: str | Column, group_by: str = "month", week_mode: str = "iso") -> Column:
    """Bucket label of a ``yyyy-MM-dd`` text date.

    ``week`` is the ISO week ``yyyy-Www`` (year of the week) by default; with
    ``week_mode='reference'`` it is the week of the month labelled with the calendar
    year, as the reference computes it (K15).
    """
    d = F.try_to_date(date_text if isinstance(date_text, Column) else F.col(date_text))
    if group_by == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if group_by == "week":
        if week_mode == "reference":
            first_dow = F.dayofweek(F.trunc(d, "MM")) - 1          # Sunday = 0, as JS getDay()
            week = F.ceil((F.dayofmonth(d) + first_dow) / 7)
            return F.format_string("%d-W%02d", F.year(d), week)
        iso_year = F.year(F.date_add(d, 3 - ((F.dayofweek(d) + 5) % 7)))   # Thursday of the ISO week
        return F.format_string("%d-W%02d", iso_year, F.weekofyear(d))
    if group_by == "quarter":
        return F.format_string("%d-Q%d", F.year(d), F.quarter(d))
    if group_by == "year":
        return F.year(d).cast("string")
    return F.date_format(d, "yyyy-MM")


def season_key(date_text: str | Column, group_by: str = "month") -> Column:
    """T3 season label: month name, ``Qn`` or weekday name."""
    d = F.try_to_date(date_text if isinstance(date_text, Column) else F.col(date_text))
    if group_by == "month":
        return F.date_format(d, "MMMM")
    if group_by == "quarter":
        return F.concat(F.lit("Q"), F.quarter(d).cast("string"))
    return F.date_format(d, "EEEE")
