"""What the order of rows says: latest, contiguous, overlap, running sums, groups by marker, ordinals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key, by an aggregate that needs no sort of the group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def contiguous(indices: Column) -> Column:
    """Whether each index of an array is the one before plus one; false for none."""
    return (F.size(indices) > 0) & F.coalesce(F.aggregate(indices, F.struct(F.lit(True).alias("ok"), F.element_at(indices, 1) .alias("want")), lambda s, i: F.struct((s["ok"] & (i == s["want"])).alias("ok"), (s["want"] + 1).alias("want")))["ok"], F.lit(False))


def overlaps(df: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """Rows that start before the one ahead of them ends."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("previous_end", before).filter(F.col(start) < F.col("previous_end"))


#: Values of an integer order column that one task takes of a key: a key with more is many tasks' work.
WIDTH = 1 << 20


def same(left: str, right: str, *columns: str) -> Column:
    """Equality of columns of two aliased tables, nulls equal."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, *, descending: bool = False, width: int = WIDTH) -> DataFrame:
    """`name`: the sum of `value` over the rows of a key up to this one, along an integer column. Rows without a key are one key's; of equal order any may come first; nulls come first (descending: last).

    Sums by ranges of the order come first, then the sums before each range, then those within a range: a key with all rows is as many tasks as it has ranges, and only a number a range goes through one.
    """
    way = F.desc if descending else F.asc
    rows = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    before = Window.partitionBy(key).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = rows.groupBy(key, "_range").agg(F.sum("_value").alias("_sum")).select(key, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    met = rows.alias("r").join(sums.alias("s"), same("r", "s", key, "_range")).select("r.*", "s._before")
    within = Window.partitionBy(key, "_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_range", "_value", "_before")


def running_budget(df: DataFrame, key: str, order: str, size: Column, width: int = WIDTH) -> DataFrame:
    return running_sum(df, key, order, size, "running", descending=True, width=width)


def group_by_marker(df: DataFrame, key: str, order: str, marker: Column, width: int = WIDTH) -> DataFrame:
    """group_no: how many markers came up to this row; 0 before the first."""
    return running_sum(df, key, order, F.when(marker, 1).otherwise(0), "group_no", width=width)


def ordinals(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
