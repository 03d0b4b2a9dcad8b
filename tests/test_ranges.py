"""Running sums and budgets by ranges of the order against plain loops, with one owner that has nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import pages, windows


def rows_of_owners(seed=1):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-300, 4000), 900)
    return [(rnd.choice([1] * 30 + [2, 3, None]), i, rnd.choice([None, 0, 5, 10, 200])) for i in ids]


SCHEMA = "artifact_id bigint, id bigint, size int"


@pytest.mark.parametrize("width", [16, 1000, 1 << 20])
def test_running_sums(spark, width):
    rows = rows_of_owners()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, by = {}, {}
    for owner, i, size in sorted(rows, key=lambda r: -r[1]):
        by[owner] = by.get(owner, 0) + (size or 0)
        want[owner, i] = by[owner]
    assert {(r.artifact_id, r.id): r.running for r in windows.running_budget(df, "artifact_id", "id", F.col("size"), width).collect()} == want
    want, by = {}, {}
    for owner, i, size in sorted(rows, key=lambda r: r[1]):
        by[owner] = by.get(owner, 0) + (size == 10)
        want[owner, i] = by[owner]
    found = windows.group_by_marker(df, "artifact_id", "id", F.col("size") == 10, width)
    assert {(r.artifact_id, r.id): r.group_no for r in found.collect()} == want and found.columns == ["artifact_id", "id", "size", "group_no"]


def plain_budget(rows, row_cap, page_cap, item_cap):
    out, state = [], {}
    cut = {}
    for owner, i, size in sorted(rows, key=lambda r: -r[1]):
        if owner in cut:
            continue
        total, n = state.get(owner, (0, 0))
        total, n = total + (size or 0), n + 1
        why = "row_bytes" if (size or 0) > row_cap else "page_bytes" if total > page_cap else "items" if item_cap is not None and n > item_cap else None
        if why:
            cut[owner] = why
            continue
        state[owner] = total, n
        out.append((owner, i, total, n))
    return sorted(((o, i, t, n, cut.get(o)) for o, i, t, n in out), key=str)


@pytest.mark.parametrize("width", [16, 1000, 1 << 20])
@pytest.mark.parametrize("caps", [(100, 10_000, None), (300, 900, None), (300, 1 << 30, 25), (10, 50, 3), (1 << 30, 1 << 30, None)])
def test_budgets(spark, width, caps):
    rows = rows_of_owners(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = pages.budget_prefix(df, F.col("size"), row_cap=caps[0], page_cap=caps[1], item_cap=caps[2], width=width)
    assert sorted(((r.artifact_id, r.id, r.running, r.place, r.cut) for r in found.collect()), key=str) == plain_budget(rows, *caps)


def test_one_owner_is_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("artifact_id"), "id", F.lit(1).alias("size"))
    found = windows.running_budget(df, "artifact_id", "id", F.col("size"), 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 1 and max(counts) < 30_000


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert windows.running_budget(df, "artifact_id", "id", F.col("size")).collect() == []
    assert pages.budget_prefix(df, F.col("size"), row_cap=1, page_cap=1).collect() == []
