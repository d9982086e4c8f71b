"""Calendar columns of a reading time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.schema import flag

# Weekday names, Monday = 0.
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def calendar_parts(ts: str) -> dict[str, Column]:
    return {
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts),
        "week_of_year": F.weekofyear(ts), "month": F.month(ts), "quarter": F.quarter(ts), "year": F.year(ts),
    }


def cyclical(part: Column, period: int) -> tuple[Column, Column]:
    angle = part * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def cyclical_encoding(ts: str) -> dict[str, Column]:
    parts, out = calendar_parts(ts), {}
    for name, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(parts[name], period)
    return out


def calendar_flags(ts: str) -> dict[str, Column]:
    hour, day, month = F.hour(ts), F.weekday(ts), F.month(ts)
    return {
        "is_business_hours": flag(hour.between(8, 18) & (day < 5)),
        "is_weekend": flag(day >= 5),
        "is_heating_season": flag((month >= 10) | (month <= 4)),
        "is_cooling_season": flag(month.between(6, 9)),
    }


def add_time_features(df: DataFrame, timestamp_col: str = "ts") -> DataFrame:
    return df.withColumns(
        calendar_parts(timestamp_col) | cyclical_encoding(timestamp_col) | calendar_flags(timestamp_col))


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), weekday + 1)
