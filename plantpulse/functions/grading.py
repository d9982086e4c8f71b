"""Severity grades, advice texts and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of the severity grades.
SEVERITY_LEVELS = {"normal": 0, "low": 1, "medium": 2, "high": 3}


def severity_level(severity: Column) -> Column:
    pairs = [F.lit(x) for item in SEVERITY_LEVELS.items() for x in item]
    return F.create_map(*pairs)[severity]


def severity_of_score(score: Column) -> Column:
    return (F.when(score > 0.7, "high").when(score > 0.4, "medium").when(score > 0.2, "low")
            .otherwise("normal"))


def classify_alert_severity(df: DataFrame, score_column: str = "ensemble_score") -> DataFrame:
    if score_column not in df.columns:
        return df
    return df.withColumn("severity", severity_of_score(F.col(score_column)))


def severity_of_probability(probability: Column) -> Column:
    return F.when(probability > 0.7, "high").when(probability > 0.3, "medium").otherwise("low")


def recommendations(prediction: Column, probability: Column, power="Power",
                    supply="T_Supply", back="T_Return") -> Column:
    """Advice texts of one scored reading, in order."""
    failing = prediction == 1
    # Advice texts and their limits.
    advice = [
        (failing, "Immediate maintenance recommended"),
        (failing & (F.col(power) > 3.0), "High power consumption detected - check compressor"),
        (failing & (F.abs(F.col(supply) - F.col(back)) > 5),
         "Large temperature differential - inspect heat exchange"),
        (~failing, "Equipment operating normally"),
        (~failing & (probability > 0.3), "Monitor closely - approaching threshold"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in advice]))


def class_name(prediction: Column) -> Column:
    return F.when(prediction == 1, "Failure").otherwise("Normal")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text rounded from the exact binary value, as C and Python print it.

    The fraction is split off first: its own shortest decimal form then shows on
    which side of a half the value lies.
    """
    size = F.abs(value)
    whole = F.floor(size)
    part = F.bround((size - whole).cast("decimal(38,30)"), digits)
    text = (whole.cast("decimal(19,0)") + part).cast(f"decimal(38,{digits})").cast("string")
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), text)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), fixed(value, 2))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value, digits), F.lit("%"))


def outdoor_label(temperature: Column) -> Column:
    return F.concat(F.lit("outdoor_"), fixed(temperature, 1), F.lit("C"))
