"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source whose target is q times its size wants q copies of each of its documents: each gets
floor(q) and, for the fractional part, a probability. Two fractional documents at a time trade
probability, in a random direction, so that the words they are expected to give stay the same,
until one of the two is at 0 or 1; the other goes on. Within a bucket of about `fan_in` documents this
is a fold; what each bucket has left enters a bucket of the next level, and so on up a tree whose
root holds one document a source, which is drawn. So the words taken of a source differ from its target
by less than one document (but for documents that are drawn alone, below), no bucket grows with the source, and a hot source has just more buckets.

Defined cases: sizes of null texts are 0; documents of size 0 have no words to balance and are drawn one by one.
Of r repeats of a row (same key, source and text), each with the fractional copies p, floor(r p) have one more copy than the others, and only what is left of r p is traded, so repeats
miss no target by more than one document either. A null source is a source of its own, last in order.
An empty table gives no rows; other columns are not read, whatever their names. Draws are hashes of key, text, source and seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN_IN = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, ...) -> with target: the total of sizes shared by weight, none above `most` times its size.

    The water level is found in closed form: with sources by rising size/weight, the first k are at
    their cap where the level left for the rest is below the next one's cap. One row a source; a global
    order of sources is what the weights are defined by.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(ratio))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .drop("weight", "cap", "total", "weights", "level", "place")
    )


def _uniform(*of: Column) -> Column:
    """A draw from [0, 1) that depends on `of` alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


ITEM = "struct<id:struct<doc_id:{key},source:string,text_hash:bigint>,size:double,p:double>"


def _fold(items: str, kind: str, level: int, seed: int) -> Column:
    """Array of items -> struct(done: items with p at 0 or 1, left: the one item still between, or null).

    The carried item is x, the next one y; x can rise until it is 1 or y is 0, or fall until it is 0 or y is 1.
    """
    return F.expr(f"""
        aggregate({items},
          named_struct('done', cast(array() as array<{kind}>), 'left', cast(null as {kind})),
          (s, y) -> if(s.left is null, named_struct('done', s.done, 'left', y),
            transform(array(named_struct(
                'x', s.left, 'y', y,
                'up', least(1 - s.left.p, y.p * y.size / s.left.size),
                'down', least(s.left.p, (1 - y.p) * y.size / s.left.size),
                'u', shiftrightunsigned(xxhash64(s.left.id, y.id, {level}, {seed}), 11) / {float(1 << 53)}D)), t ->
              if(t.u * (t.up + t.down) < t.down,
                 if(t.up >= 1 - t.x.p,
                    named_struct('done', array_append(s.done, named_struct('id', t.x.id, 'size', t.x.size, 'p', 1D)),
                                 'left', named_struct('id', t.y.id, 'size', t.y.size, 'p', greatest(t.y.p - t.up * t.x.size / t.y.size, 0D))),
                    named_struct('done', array_append(s.done, named_struct('id', t.y.id, 'size', t.y.size, 'p', 0D)),
                                 'left', named_struct('id', t.x.id, 'size', t.x.size, 'p', t.x.p + t.up))),
                 if(t.down >= t.x.p,
                    named_struct('done', array_append(s.done, named_struct('id', t.x.id, 'size', t.x.size, 'p', 0D)),
                                 'left', named_struct('id', t.y.id, 'size', t.y.size, 'p', least(t.y.p + t.down * t.x.size / t.y.size, 1D))),
                    named_struct('done', array_append(s.done, named_struct('id', t.y.id, 'size', t.y.size, 'p', 1D)),
                                 'left', named_struct('id', t.x.id, 'size', t.x.size, 'p', t.x.p - t.down)))))[0]))
    """)  # fmt: skip


def mix(docs: DataFrame, *, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, fan_in: int = FAN_IN, seed: int = 17) -> DataFrame:
    """doc_id, source, text_hash, size, rows (equal rows of the input), source_size, target, copies, extra, taken: one row for each distinct row of `docs`.

    Each of the equal rows has `copies`, and `extra` of them one more; taken is for all of them.
    """
    kind = docs.schema[key].dataType.simpleString()
    items = written(
        docs.select(F.col(key).alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("rows")),
        "mix-items",
    )
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("docs"))
    sources = written(source_targets(sources, weights, most), "mix-sources")
    most_docs = sources.agg(F.max("docs")).first()[0] or 0  # one number: the height of the tree
    levels = max(1, math.ceil(math.log(max(2, most_docs), fan_in)))

    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = (
        items.alias("i").join(sources.alias("s"), F.expr("i.source <=> s.source"))
        .select("i.*", "source_size", "target", "docs", want.alias("want"))
        .withColumn("base", F.floor("want").cast("int"))
        .withColumn("p", (F.col("want") - F.col("base")) * F.col("rows"))
        .withColumn("whole", F.floor("p").cast("long"))  # rows that have one copy more, whatever is drawn
        .withColumn("p", F.col("p") - F.col("whole"))
        .withColumn("id", F.struct("doc_id", "source", "text_hash"))
    )
    item = ITEM.format(key=kind)
    waiting = (
        wanted.filter((F.col("p") > 0) & (F.col("size") > 0))
        .select(F.struct("id", F.col("size").cast("double").alias("size"), "p").cast(item).alias("item"), "source",
                F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("docs") / fan_in)).alias("bucket"), "docs")
    )
    decided = None
    for level in range(levels):
        # the last level has one bucket a source by construction: docs <= fan_in ** levels
        bucket = F.col("bucket") if level < levels - 1 else F.lit(0).cast("long")
        folded = (
            waiting.groupBy("source", bucket.alias("bucket"))
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select("source", "bucket", _fold("items", item, level, seed).alias("r"))
        )
        folded = written(folded, f"mix-level{level}")
        done = folded.select(F.explode("r.done").alias("item"))
        decided = done if decided is None else decided.unionByName(done)
        waiting = folded.filter("r.left is not null").select(F.col("r.left").alias("item"), "source", F.expr(f"bucket div {fan_in}").alias("bucket"))
    last = waiting.select(F.col("item").withField("p", (_uniform(F.col("item.id"), F.lit(seed + 1)) < F.col("item.p")).cast("double")).alias("item"))
    extra = decided.unionByName(last).select("item.id.*", F.col("item.p").cast("int").alias("extra"))
    lone = (_uniform(F.col("w.id"), F.lit(seed + 2)) < F.col("w.p")).cast("int")
    same = F.expr("w.doc_id <=> e.doc_id and w.source <=> e.source and w.text_hash = e.text_hash")
    extra_rows = F.col("whole") + F.when(F.col("size") == 0, lone).otherwise(F.coalesce("e.extra", F.lit(0)))
    return (
        wanted.alias("w").join(extra.alias("e"), same, "left")
        .select(*(F.col(f"w.{c}") for c in ("doc_id", "source", "text_hash", "size", "rows", "source_size", "target")), F.col("base").alias("copies"), extra_rows.cast("long").alias("extra"))
        .withColumn("copies", F.col("copies") + (F.col("extra") == F.col("rows")).cast("int")).withColumn("extra", F.col("extra") % F.col("rows"))
        .withColumn("taken", (F.col("copies") * F.col("rows") + F.col("extra")) * F.col("size"))
    )


def each_row(mixed: DataFrame) -> DataFrame:
    """As mix(), a row for each row of its input: copies and taken are the row's own."""
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row")
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "extra", row)
    own = F.col("copies") + (F.col("row") <= F.col("extra")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))


def taken_rows(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: each row of `docs` as often as `mixed` takes it, with the columns of `docs`.

    Rows are told from their repeats by a number, only where some of them have a copy more than others.
    """
    same = (F.col(f"d.row.{key}").eqNullSafe(F.col("m.doc_id"))) & (F.col("d.row.source").eqNullSafe(F.col("m.source"))) & (F.xxhash64("d.row.text") == F.col("m.text_hash"))
    kept = written(mixed.filter("copies > 0 or extra > 0").select("doc_id", "source", "text_hash", "copies", "extra"), "mix-taken").alias("m")
    found = docs.select(F.struct("*").alias("row")).alias("d").join(kept, same).select("d.row", "m.*")
    alike = Window.partitionBy("doc_id", "source", "text_hash").orderBy(F.lit(0))
    uneven = found.filter("extra > 0").withColumn("copies", F.col("copies") + (F.row_number().over(alike) <= F.col("extra")).cast("int")).filter("copies > 0")
    times = lambda df: df.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")).select("row.*")
    return times(found.filter("extra = 0")).union(times(uneven)) if kept.filter("extra > 0").limit(1).count() else times(found)
