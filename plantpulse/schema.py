"""Sensor columns, their descriptions and the allowed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "Timestamp"
SENSORS = [
    "T_Supply", "T_Return", "SP_Return", "T_Saturation", "T_Outdoor",
    "RH_Supply", "RH_Return", "RH_Outdoor", "Energy", "Power",
]

# Column descriptions.
DESCRIPTIONS = {
    "Timestamp": "Date and time of measurement",
    "T_Supply": "Supply air temperature (°C)",
    "T_Return": "Return air temperature (°C)",
    "SP_Return": "Return air temperature setpoint (°C)",
    "T_Saturation": "Saturation temperature (°C)",
    "T_Outdoor": "Outdoor temperature (°C)",
    "RH_Supply": "Supply air relative humidity (%)",
    "RH_Return": "Return air relative humidity (%)",
    "RH_Outdoor": "Outdoor relative humidity (%)",
    "Energy": "Cumulative energy consumption (kWh)",
    "Power": "Instantaneous power consumption (kW)",
}

# Limits of the batch range check.
CHECK_RANGES = {
    "T_Supply": (-10.0, 50.0),
    "T_Return": (-10.0, 50.0),
    "T_Saturation": (-10.0, 50.0),
    "T_Outdoor": (-30.0, 60.0),
    "RH_Supply": (0.0, 100.0),
    "RH_Return": (0.0, 100.0),
    "RH_Outdoor": (0.0, 100.0),
    "Energy": (0.0, 1e6),
    "Power": (0.0, 1000.0),
}

# Limits a single reading must meet to be scored (None = open).
CONTRACT_RANGES = {
    "T_Supply": (-10.0, 50.0),
    "T_Return": (-10.0, 50.0),
    "SP_Return": (-10.0, 50.0),
    "T_Saturation": (-10.0, 50.0),
    "T_Outdoor": (-30.0, 60.0),
    "RH_Supply": (0.0, 100.0),
    "RH_Return": (0.0, 100.0),
    "RH_Outdoor": (0.0, 100.0),
    "Energy": (0.0, None),
    "Power": (0.0, None),
}

# Columns that never serve as model features.
LABEL_COLUMNS = ["failure_imminent", "rul", "is_failure", "failure_window"]


def sensor_schema(time_column: str = TIME, time_type: T.DataType | None = None) -> T.StructType:
    fields = [T.StructField(time_column, time_type or T.TimestampType(), False)]
    fields += [T.StructField(c, T.DoubleType(), True) for c in SENSORS]
    return T.StructType(fields)


def described(schema: T.StructType) -> T.StructType:
    """The same schema with each known description kept as field comment."""
    return T.StructType([
        T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "comment": DESCRIPTIONS[f.name]})
        if f.name in DESCRIPTIONS else f
        for f in schema.fields
    ])


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker only: NaN becomes NULL."""
    floats = set(float_columns(df))
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def flag(condition: Column) -> Column:
    """0/1 flag in which a missing comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
