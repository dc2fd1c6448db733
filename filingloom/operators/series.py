"""Deviation and anomaly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mape(actual: Column, expected: Column) -> Column:
    return F.abs(F.try_divide(actual - expected, actual)) * 100


def zone(deviation: Column, green: float, amber: float) -> Column:
    return F.when(deviation.isNull(), None).when(deviation <= green, "green").when(deviation <= amber, "amber").otherwise("red")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.abs(value - mean) / F.when(std == 0, 1.0).otherwise(std)


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of both, first only, second only and none."""
    kind = F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("none")
    return df.groupBy(kind.alias("agreement")).agg(F.count("*").alias("n"))
