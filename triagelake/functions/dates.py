"""Business days and short dates. Today is always given, so results can be had again."""

from __future__ import annotations

from pyspark.sql import Column

from . import lazy as F


def add_business_days(day: Column, n: Column) -> Column:
    """n working days later (n > 0): closed form, no loop. From a weekend, counting starts on Monday."""
    w = F.weekday(day)
    w2 = F.least(w, F.lit(4))
    return F.date_add(day, (w2 - w + n + 2 * F.floor((w2 + n) / 5)).cast("int"))


def friendly_date(day: Column, today: Column) -> Column:
    ahead = F.date_diff(day, today)
    return F.when(ahead == 0, F.lit("today")).when(ahead == 1, F.lit("tomorrow")).otherwise(F.date_format(day, "EEE, MMM d"))
