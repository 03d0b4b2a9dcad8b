"""Trees of digests against row-by-row comparison."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from provenant.operators import integrity as I

SCHEMA = "id bigint, a string, b int"


def plain_root(digests, fan):
    """digests: (key, digest of a row). The tree, level by level, with dictionaries."""
    level, span = {}, [k for k, _ in digests if k is not None]
    for k, d in sorted(digests, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        level.setdefault(None if k is None else k // fan, []).append(d)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    level = {k: sha(v) for k, v in level.items()}
    first, last = (min(span) // fan, max(span) // fan) if span else (0, 0)
    in_order = lambda d: sorted(d, key=lambda k: (k is not None, k or 0))
    while last - first >= fan:
        up = {}
        for k in in_order(level):
            up.setdefault(None if k is None else k // fan, []).append(level[k])
        level = {k: sha(v) for k, v in up.items()}
        first, last = first // fan, last // fan
    return sha([level[k] for k in in_order(level)])


def table(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    keys = rnd.sample(range(-5000, 200_000), n)
    return [(k, rnd.choice([None, "", "x", "żó"]), rnd.choice([None, 1, 2])) for k in keys] + [(None, "no key", 1), (7, "twice", 1), (7, "twice", 2)]


@pytest.fixture
def tree(spark, tmp_path):
    """Trees as they are used: stored."""

    def stored(df, fan):
        path = str(tmp_path / uuid.uuid4().hex)
        I.digest_tree(df, fan=fan).write.parquet(path)
        return spark.read.parquet(path)

    return stored


def test_root_is_a_plain_tree(spark):
    for rows in (table(spark, 500), [(1, "a", 1)], [], [(None, "x", 1)]):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        digests = [(r.id, r.d) for r in df.select("id", I.row_digest(df.columns).alias("d")).collect()]
        for fan in (40, 10_000):
            nodes = I.digest_tree(df, fan=fan).collect()
            root = max(nodes, key=lambda r: r.level)
            assert root.node == 0 and root["rows"] == len(rows) and root.digest == plain_root(digests, fan)
            assert I.table_digests({"t": df}, {"t": "id"}, fan).first().digest == root.digest
            children = {}
            for r in nodes:
                if r.level > 1 or r.node is None:
                    continue
                children[r.node // fan] = children.get(r.node // fan, 0) + 1
            assert all(n <= fan for n in children.values())


def test_changes_are_found_where_trees_differ(spark, tree):
    rows = table(spark, 800)
    rnd = random.Random(3)
    later = [(k, a, 5 if i in (10, 700) else b) for i, (k, a, b) in enumerate(rows) if i not in (20, 21)] + [(500_000, "new", 1), (-9, "new", 1), (7, "twice", 3)]
    rnd.shuffle(later)
    before, after = (spark.createDataFrame(x, SCHEMA) for x in (rows, later))
    counts = lambda x: {k: sorted(map(repr, (r for r in x if r[0] == k))) for k in {r[0] for r in x}}
    old, new = counts(rows), counts(later)
    want = {k: "added" if k not in old else "removed" if k not in new else "changed" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    for fan in (30, 1000):
        ranges = I.changed_ranges(tree(before, fan), tree(after, fan), fan)
        assert ranges.count() <= len(want)
        found = {r.key: r.change for r in I.changed_rows(before, after, ranges, fan=fan).collect()}
        assert found == want
    assert I.changed_ranges(tree(before, 50), tree(before.repartition(7), 50), 50).count() == 0


def test_rows_without_a_key_and_empty_tables(spark, tree):
    some, none = spark.createDataFrame([(None, "x", 1), (1, "y", 2)], SCHEMA), spark.createDataFrame([], SCHEMA)
    other = some.withColumn("a", F.when(F.col("id").isNull(), "z").otherwise(F.col("a")))
    ranges = I.changed_ranges(tree(some, 10), tree(other, 10), 10)
    assert [(r.key, r.change) for r in I.changed_rows(some, other, ranges, fan=10).collect()] == [(None, "changed")]
    ranges = I.changed_ranges(tree(some, 10), tree(none, 10), 10)
    assert sorted((r.key or 0, r.change) for r in I.changed_rows(some, none, ranges, fan=10).collect()) == [(0, "removed"), (1, "removed")]
