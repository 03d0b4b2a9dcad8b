"""Similarity join on word shingles: rare-first prefix filtering with length, positional and suffix filters.

1. One pass turns each text into its set of shingles (64-bit hashes): its size, a digest that names the set, and a 512-bit sketch that holds
   the parity of how many shingles fall in each of 512 partitions. Equal sets are one class from here on. The pass also counts shingles
   in a table of fixed size (2^22 cells), from which rarity is read: it only orders shingles, so a shared cell costs speed, never a link.
2. With a set's shingles in order of rarity, two sets that reach the threshold share one of their first n - ceil(t n) + 1. The sets of one
   prefix shingle form a list. Their sizes (length filter) and the places of the shingle (positional filter) bound what they can share.
   The suffix filter bounds the size of the symmetric difference from below by the partitions whose parity differs.
3. Lists are first linked along two orders, neighbours only; what these prove is joined into components. Then all pairs of a list that are still in
   different components and pass the filters are verified, each once. Pairs within a component need no look: they
   can't change it. So a group of thousands of near copies doesn't turn into all its pairs, and no link between components is lost.
4. A pair is verified on the whole sets.

A shingle that a great part of the sets share has a list as long: its list is dealt into parts by a hash of the set, as many as the table of counts asks for, in each of the
two orders by another hash, so that no window holds it whole; sizes are cut into bands as wide as the length filter allows, and only neighbouring bands of a list are joined.

The links verified connect what all links connect; they are not all links. Texts that are null or have no word have an empty set and link with nothing; repeated
rows are one class; an empty table gives no rows. Sets, not keys, are compared: rows with a null key, and rows that share a key, link by their own texts. A null key leads no
component, unless all of a component's keys are null: then its component is null. Other columns are not read. Hashes stand for shingles and texts: a false agreement has a chance
of about 2^-64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import TEXT_ROWS_PER_BATCH, discard, few, let_go, written
from provenant.llm.components import components
from provenant.llm.shingles import mix64, shingle_set

WIDTH, PERCENT = 4, 85
COUNT_BITS = 22
#: Shared shingles of a set up to which a list entry names the earlier ones.
MOST_EARLIER = 48
#: The table of counts travels in so many slices, each summed by itself.
SLICES = 64
#: Sets of one list that one window holds, about; more where common shingles are common everywhere.
LIST_ROWS = 2000
SKETCH_WORDS = 8
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix64(hashes) >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows of two kinds: a document's (key, hash of its text, n, digest, sketch), and at the end of each partition the slices of its counts (slice, counts)."""
    cut = (1 << COUNT_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts, seen = np.zeros(1 << COUNT_BITS, np.int32), set()
        ints = pa.int64()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                some = batch.slice(at, TEXT_ROWS_PER_BATCH)
                n, names, sketches = [], [], []
                for t in some.column(2).to_pylist():
                    s = shingle_set(t, width)
                    n.append(len(s))
                    names.append(name := _digest(s))
                    sketches.append(_sketch(s))
                    if name not in seen:
                        seen.add(name)
                        np.add.at(counts, _cells(s), 1)
                columns = np.array(sketches).reshape(-1, SKETCH_WORDS).T
                rest = [pa.nulls(some.num_rows, pa.int32()), pa.nulls(some.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(ints), some.column(1), pa.array(n, ints), pa.array(names, ints), *(pa.array(c, ints) for c in columns), *rest], names=["id", "text_hash", "n", "digest", *_SKETCH, "slice", "counts"])
        if seen:
            parts = [counts[i * cut : (i + 1) * cut] for i in range(SLICES)]
            empty = [pa.nulls(SLICES, ints)] * (4 + SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int32()), pa.array([_squeezed(p) for p in parts], pa.binary())], names=["id", "text_hash", "n", "digest", *_SKETCH, "slice", "counts"])

    sketch = "".join(f", {c} bigint" for c in _SKETCH)
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, f"id bigint, text_hash bigint, n bigint, digest bigint{sketch}, slice int, counts binary")


def _squeezed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i4").tobytes())


def _expanded(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").astype(np.int64)


def frequencies(rows: DataFrame) -> np.ndarray:
    """The summed table of counts: 2^COUNT_BITS numbers, whatever the input is; each slice is summed in a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[s] = sums[s] + _expanded(c) if s in sums else _expanded(c)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_squeezed(np.minimum(v, 2**31 - 1)) for v in sums.values()], pa.binary())], names=["slice", "counts"])

    parts = rows.filter("slice is not null").select("slice", "counts").mapInArrow(add, "slice int, counts binary")
    out = np.zeros(1 << COUNT_BITS, np.float32)
    cut = (1 << COUNT_BITS) // SLICES
    for s, c in parts.repartition(SLICES // 4, "slice").mapInArrow(add, "slice int, counts binary").toLocalIterator():
        out[s * cut : (s + 1) * cut] = _expanded(bytes(c))
    return out


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """The least intersection with which sets of these sizes reach the threshold, in whole numbers."""
    return F.floor(((n1 + n2) * F.lit(percent) + F.lit(99 + percent)) / F.lit(100 + percent)).cast("long")


def postings(docs: DataFrame, text: str, counts, width: int, percent: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """shingle, digest, n, place, deals: the prefix of each distinct set of a partition, rarest shingles first; deals is in how many parts the shingle's list is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table, seen = counts.value, set()
        room = max(list_rows, 8 * float(table.mean()))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                out = [[], [], [], [], []]
                for t in batch.column(0).slice(at, TEXT_ROWS_PER_BATCH).to_pylist():
                    s = shingle_set(t, width)
                    name, n = _digest(s), len(s)
                    if not n or name in seen:
                        continue
                    seen.add(name)
                    first = n - (percent * n + 99) // 100 + 1
                    often = table[_cells(s)]
                    order = np.lexsort((s, often))[:first]
                    out[0].append(s[order].view(np.int64))
                    out[1].append(np.full(first, name, np.int64))
                    out[2].append(np.full(first, n, np.int32))
                    out[3].append(np.arange(first, dtype=np.int32))
                    out[4].append(np.ceil(often[order] / room).astype(np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["shingle", "digest", "n", "place", "deals"])

    return docs.select(text).mapInArrow(run, "shingle bigint, digest bigint, n int, place int, deals int")


def _possible(x: str, y: str, percent: int, *, suffix: bool) -> Column:
    """Length and positional filter of two list entries, and the suffix filter where they hold sketches."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n1, n2 = c(x, "n"), c(y, "n")
    least = needed(n1, n2, percent)
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    place = F.least(n1 - c(x, "place"), n2 - c(y, "place")) >= least
    if not suffix:
        return length & place
    differ = sum((F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in _SKETCH), F.lit(0))
    return length & place & (differ <= n1 + n2 - 2 * least)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """a, b (digests): the pairs whose whole sets reach the threshold. Only texts that some pair names travel, compressed: half as much as their sets."""

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            keep = [not (d in seen or seen.add(d)) for d in b.column(0).to_pylist()]
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["digest", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        expand = zstandard.ZstdDecompressor()

        @lru_cache(64)  # one text is in many pairs that come together
        def of(_: int, body: bytes) -> np.ndarray:
            return shingle_set(expand.decompress(body).decode(), width)

        for b in batches:
            keep = []
            for x, y, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, t = of(x, p), of(y, q)
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = pairs.select(F.col("a").alias("digest")).distinct().union(pairs.select(F.col("b").alias("digest")).distinct()).distinct()
    named = written(named.join(reps.select("digest", "at.*"), "digest").select("digest", F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "named")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # one row holds a set: that of the least key whose text has it, found again by key and text
    whole = texts.join(few(named), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("digest", "text").mapInArrow(pressed, "digest bigint, body binary")
    whole = written(whole, "texts")
    if whole.count() > named.count():  # repeats of a whole row, in several tasks
        once = written(whole.groupBy("digest").agg(F.first("body").alias("body")), "texts")
        discard(whole)
        whole = once
    a, b = whole.toDF("a", "left"), whole.toDF("b", "right")
    found = written(pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint"), "links")
    discard(whole, named, pairs)
    return found


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, list_rows: int = LIST_ROWS) -> DataFrame:
    """`key`, n_shingles, component_id: the least key that links reach, its own included; one row for each row of `docs`. Keys are integers."""
    spark = docs.sparkSession
    rows = written(described(docs, key, text, width), "described")
    facts = rows.filter("slice is null").drop("slice", "counts")
    counts = spark.sparkContext.broadcast(frequencies(rows))  # 16 MB, always
    # one representative a set: the least key that is not null
    reps = facts.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("at"), *(F.first(c).alias(c) for c in _SKETCH))
    reps = written(reps, "sets-named")

    dealt = postings(docs, text, counts, width, percent, list_rows).withColumn("deal", _deal(3))
    alike = Window.partitionBy("shingle", "deal")
    lists = (
        dealt.withColumn("low", F.min("digest").over(alike)).withColumn("high", F.max("digest").over(alike))
        .filter("low < high or deals > 1")  # a list in several parts is long
        .groupBy("shingle", "deal", "digest").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.first("deals").alias("deals"))
    )
    lists = written(lists, "lists")

    links = labels = None
    passing = [reps]
    entry = ["digest", "n", "place"]
    for deal, order in ((F.col("deal"), ("n", "digest")), (_deal(4), (F.xxhash64("digest", F.lit(5)), "digest"))):
        here = _labelled(lists.withColumn("deal", deal), labels)
        along = Window.partitionBy("shingle", "deal").orderBy(*order)
        ahead = here.select("label", F.struct(*entry).alias("x"), F.lead(F.struct(*entry, "label")).over(along).alias("y")).filter("y is not null and label <> y.label")
        pairs = ahead.filter(_possible("x", "y", percent, suffix=False)).select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()
        found = verified(written(pairs, "pairs"), reps, docs, key, text, width, percent)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        passing += [found, labels]
    here = _labelled(lists, labels)
    mixed = here.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    here = here.join(mixed, "shingle").groupBy("digest", "n", "label").agg(F.array_sort(F.collect_list(F.struct("place", "shingle"))).alias("of"))
    band = F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    here = here.join(reps.drop("at"), "digest").select("digest", "n", "label", band.alias("band"), *_SKETCH, F.posexplode("of").alias("at", "e"), "of")
    earlier = F.when(F.size("of") <= MOST_EARLIER, F.transform(F.slice("of", 1, F.col("at")), lambda e: e["shingle"])).otherwise(F.array().cast("array<bigint>"))
    here = written(here.select("e.shingle", "e.place", "digest", "n", "label", "band", *_SKETCH, earlier.alias("earlier")), "mixed-lists")
    discard(lists)
    x, y = here.alias("x"), here.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.digest") < F.col("y.digest")) & (F.col("x.label") != F.col("y.label"))
    # a pair comes from the first list that holds both, so that it isn't made again by each further one
    first = ~F.arrays_overlap("x.earlier", "y.earlier")
    rest = written(x.join(y, apart & _possible("x", "y", percent, suffix=True) & first).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct(), "pairs")
    discard(here)
    found = verified(rest, reps, docs, key, text, width, percent)
    labels = components(links.unionByName(found))
    passing += [found, labels]
    groups = labels.select(F.col("node").alias("digest"), F.col("component").alias("label"))

    # from the least digest of a component to the least key of its rows
    owned = reps.select("digest", "at.id").join(groups, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = owned.groupBy("label").agg(F.min("id").alias("component_id"))
    owned = written(owned.join(least, "label").select("digest", "component_id"), "classes")
    discard(*passing)
    return (
        facts.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(owned, "digest", "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )


def _deal(seed: int) -> Column:
    """Which part of its list an entry is in."""
    return F.when(F.col("deals") > 1, F.pmod(F.xxhash64("digest", F.lit(seed)), F.col("deals").cast("long"))).otherwise(F.lit(0)).cast("int")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("digest"))
    return lists.join(few(labels.toDF("digest", "found")), "digest", "left").withColumn("label", F.coalesce("found", "digest")).drop("found")


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose key leads its component, with the columns of `docs`; of rows that share a key, all or none stay."""
    lead = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_lead")).distinct()
    return docs.join(lead, F.col(key).cast("long").eqNullSafe(F.col("_lead")), "left_semi")
