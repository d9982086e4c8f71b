"""Thermal and efficiency columns, each only when its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN_GUARD = 0.001


def nonzero(value: Column) -> Column:
    """Zero counts as missing."""
    return F.when(value != 0, value)


def finite(value: Column) -> Column:
    """Infinite counts as missing."""
    return F.when(F.abs(value) != float("inf"), value)


def thermal_domain(columns: list[str]) -> dict[str, Column]:
    supply, back = F.col("T_Supply"), F.col("T_Return")
    rules = {
        "temp_difference": (("T_Supply", "T_Return"), back - supply),
        "temp_efficiency": (("T_Supply", "T_Return"), F.try_divide(supply, nonzero(back))),
        "temp_lift": (("T_Supply", "T_Outdoor"), supply - F.col("T_Outdoor")),
        "rh_difference": (("RH_Supply", "RH_Return"), F.col("RH_Return") - F.col("RH_Supply")),
        "saturation_margin": (("T_Saturation", "T_Supply"), F.col("T_Saturation") - supply),
        "setpoint_deviation": (("SP_Return", "T_Return"), back - F.col("SP_Return")),
    }
    return {name: expr for name, (needs, expr) in rules.items() if set(needs) <= set(columns)}


def calculate_efficiency_metrics(
    df: DataFrame, power_col="Power", temp_col="T_Supply", outdoor_temp="T_Outdoor",
) -> DataFrame:
    """Temperature lift (0 becomes 0.001), power per degree and lift per power."""
    if not {temp_col, outdoor_temp} <= set(df.columns):
        return df
    raw = F.col(temp_col) - F.col(outdoor_temp)
    df = df.withColumn("temp_lift", F.when(raw == 0, KELVIN_GUARD).otherwise(raw))
    if power_col not in df.columns:
        return df
    lift = F.abs("temp_lift")
    return df.withColumns({
        "power_per_degree": F.try_divide(F.col(power_col), lift),
        "efficiency_ratio": F.try_divide(lift, F.col(power_col) + KELVIN_GUARD),
    })
