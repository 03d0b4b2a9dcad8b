"""Connected components of a table of links, by contraction.

In a round each node points at the least of itself and its neighbours; pointers are followed to their ends by doubling, and the links between different ends are
the next round's. Each round at least halves the nodes that still have links, so the sum of all rounds' rows is bounded by a small multiple of the links,
and rounds grow with the logarithm of the nodes. All tables are written to the shared folder; only counts come to the driver. Pointers are broadcast while the nodes are few
enough, by count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import FEW_ROWS, discard, written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its least node): one row for each node that has a link to another. No links give no rows."""
    a, b = F.col(left), F.col(right)
    edges = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        both = edges.union(edges.select("b", "a")).toDF("x", "y")
        ends = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("to")), "ends")
        few = ends.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        held = F.broadcast if few else lambda df: df
        moved = True
        while moved:
            up = ends.select(F.col("x").alias("up"), F.col("to").alias("top"))
            further = written(ends.join(held(up), F.col("to") == F.col("up")).select("x", F.col("top").alias("to"), (F.col("top") < F.col("to")).alias("moved")), "ends")
            discard(ends)
            ends, moved = further, bool(further.filter("moved").limit(1).count())
        rounds.append(ends)
        of = lambda name: held(ends.select(F.col("x").alias(f"at_{name}"), F.col("to").alias(f"to_{name}")))  # noqa: B023, E731
        met = edges.join(of("a"), F.col("a") == F.col("at_a")).join(of("b"), F.col("b") == F.col("at_b"))
        left_over = written(met.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        discard(edges)
        edges = left_over
        if not edges.limit(1).count():
            break
    found = rounds[-1].select("x", "to")
    for ends in reversed(rounds[:-1]):
        later = found.toDF("then", "last")
        found = ends.join(later, F.col("to") == F.col("then"), "left").select("x", F.coalesce("last", "to").alias("to"))
    out = written(found.toDF("node", "component"), "components")
    discard(edges, *rounds)
    return out
