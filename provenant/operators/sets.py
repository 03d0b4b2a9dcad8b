"""Unions, differences and intersections of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_cases(direct: DataFrame, observed: DataFrame) -> DataFrame:
    return direct.union(observed).distinct()


def union_messages(sms: DataFrame, mms: DataFrame) -> DataFrame:
    return sms.unionByName(mms)


def selected_phones(preset: DataFrame, manual: DataFrame, excluded: DataFrame) -> DataFrame:
    """(preset and manual) without excluded."""
    return preset.union(manual).distinct().join(excluded, "phone", "left_anti")


def default_presets(defaults: Column, available: Column) -> Column:
    """Defaults that are available, each once, in the order they are first named."""
    return F.array_distinct(F.filter(defaults, lambda d: F.array_contains(available, d)))


def table_set_difference(expected: Column, actual: Column) -> Column:
    """struct(missing, unexpected): what either list has alone, sorted."""
    return F.struct(F.array_sort(F.array_except(expected, actual)).alias("missing"), F.array_sort(F.array_except(actual, expected)).alias("unexpected"))
