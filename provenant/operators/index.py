"""An inverted index that lives between queries: segments of Parquet tables and a manifest that names the live ones.

A segment holds the documents of one batch, in three tables. `docs` has the tokens of each document, in order. `postings` has a row for each term and block of documents: the documents, their lengths, and the
term's places in each (the file format keeps differences), beside the largest count and the least length in the block, from which a bound on any of its scores follows. `terms` has each term with its numbers of documents and
of tokens. Postings and terms are in ranges of terms, a folder each, and `ranges` says which terms lie where: a query opens the folders of its own terms alone, a prefix those that its range of terms meets.
Documents of like length share a block, so that bounds are tight: a task sorts what it holds by length before it cuts blocks.

A batch that comes later is a segment of its own; no other is touched. A document that comes again, or is deleted, is marked dead in the segment that has it. Segments of like size are merged when there are many.
Each change ends with a new manifest, created and never overwritten: a change that fails before leaves the index as it was, and of two at once the later one fails.
The columns of a document lie in one row of places, each from a multiple of GAP on, so that no phrase crosses them.

Null texts are empty; empty documents count as documents. A null key can't be found again, so it is refused; of a batch's documents with one key only one may come. Columns of other names are left out.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provenant.operators.search import TERM, Near, Phrase, bm25_part, fold, phrases_of

#: Documents of a block, about; tokens of a range of terms, about; tokens that a column can have.
BLOCK = 256
RANGE_TOKENS = 2_000_000
GAP = 1 << 24
#: So many segments of like size (within the factor) are merged into one.
MERGE_AT, TIER = 8, 8
#: Tokens that a task holds at once when it makes postings, four times those of a block at most (a longer document is a block of its own); tokens looked at for each range when ranges are cut.
TASK_TOKENS, CUT_SAMPLE = 2_000_000, 100
#: Rows up to which dead documents, or the blocks that a query needs, are broadcast.
FEW = 200_000
POSTINGS = "term string, block bigint, n int, max_tf int, min_len int, tf bigint, docs array<{kind}>, lens array<int>, tfs array<int>, places array<array<int>>, range int"


class Index(NamedTuple):
    spark: SparkSession
    path: str
    state: dict

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.state["columns"])

    @property
    def n_docs(self) -> int:
        return sum(s["docs"] - s["dead"] for s in self.state["segments"])

    @property
    def mean_length(self) -> float:
        return sum(s["tokens"] - s["dead_tokens"] for s in self.state["segments"]) / max(1, self.n_docs)

    def at(self, segment: str, table: str) -> str:
        return f"{self.path}/{segment}/{table}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(index: Index, state: dict) -> Index:
    """The next manifest. It is created, not overwritten, so one of two writers fails."""
    state = state | {"version": index.state["version"] + 1}
    path, fs = _fs(index.spark, f"{index.path}/manifest/{state['version']:08}.json")
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    return index._replace(state=state)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index as the last whole manifest names it."""
    folder, fs = _fs(spark, f"{path}/manifest")
    for name in sorted((s.getPath().toString() for s in fs.listStatus(folder)), reverse=True):
        text = "\n".join(r.value for r in spark.read.text(name).collect())  # one small file
        try:
            return Index(spark, path, json.loads(text))
        except ValueError:  # a writer ended in the middle
            continue
    raise ValueError(f"no index at {path}")


def create_index(docs: DataFrame, path: str, key: str = "object_id", columns: tuple[str, ...] = ("title", "content"), *, range_tokens: int = RANGE_TOKENS) -> Index:
    empty = Index(docs.sparkSession, path.rstrip("/"), {"version": 0, "columns": list(columns), "key_type": docs.schema[key].dataType.simpleString(), "range_tokens": range_tokens, "segments": []})
    return add(empty, docs, key)


def _tokens(docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """doc, len, tokens: an array of tokens for each column."""
    terms = F.array(*(F.regexp_extract_all(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(TERM), F.lit(0)) for c in columns))
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.array(terms)).alias("tokens"))  # exploded, so that texts are taken apart once
    return rows.select("doc", F.aggregate("tokens", F.lit(0), lambda n, t: n + F.size(t)).alias("len"), "tokens")


def _cuts(docs: DataFrame, ranges: int, n_tokens: int) -> list[tuple[str, float]]:
    """Where ranges of (term, share of its blocks) begin, but the first: from a sample of about CUT_SAMPLE tokens a range. They decide where a row lies, not what is in it."""
    if ranges == 1:
        return []
    words = docs.select(F.explode(F.flatten("tokens")).alias("term"))
    found = sorted(r.term for r in words.sample(min(1.0, CUT_SAMPLE * ranges / n_tokens), 1).collect())
    at = sorted({len(found) * i // ranges for i in range(1, ranges)}) if found else []
    return sorted({(found[i], (i - bisect_left(found, found[i])) / (bisect_right(found, found[i]) - bisect_left(found, found[i]))) for i in at})


def _blocks(lens: np.ndarray, most_docs: int, most_tokens: int) -> np.ndarray:
    """The block of each of some documents that are in order of length."""
    out, at, docs, tokens = np.empty(len(lens), np.int64), 0, 0, 0
    for i, n in enumerate(lens.tolist()):
        if docs and (docs == most_docs or tokens + n > most_tokens):
            at, docs, tokens = at + 1, 0, 0
        out[i], docs, tokens = at, docs + 1, tokens + n
    return out


def _pack_schema(kind: pa.DataType) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([("term", pa.string()), ("block", pa.int64()), ("docs", pa.list_(kind)), ("lens", ints), ("tfs", ints), ("places", ints)])


def _ranges_of(terms: list[str], term: np.ndarray, block: np.ndarray, cuts: list[tuple[str, float]]) -> np.ndarray:
    """The range of each row of (place in `terms`, block). Rows of a term that ranges share are dealt by their block."""
    begins, ends = ([f(terms, t) for t, _ in cuts] for f in (bisect_left, bisect_right))
    out = np.searchsorted(np.array(ends, np.int64), term, "right").astype(np.int32)
    share = (block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64  # evenly spread, whatever blocks there are
    for at in sorted({i for i, j in zip(begins, ends, strict=True) if i < j}):
        rows = slice(*np.searchsorted(term, [at, at + 1]))
        out[rows] += np.searchsorted([u for (_, u), i, j in zip(cuts, begins, ends, strict=True) if i == at < j], share[rows], "right").astype(np.int32)
    return out


def _packs(held: pa.Table, first_block: int, cuts: list[tuple[str, float]], most_docs: int, most_tokens: int, kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
    """Postings of some documents, cut into blocks of like length: a compressed row a range (range, size, pack). Places are kept as differences. Also the number of blocks."""
    held = held.take(np.argsort(held.column("len").to_numpy(), kind="stable"))
    held = held.append_column("block", pa.array(_blocks(held.column("len").to_numpy(), most_docs, most_tokens)))
    held = held.take(pc.sort_indices(held, [("block", "ascending"), ("doc", "ascending")])).combine_chunks()
    doc, lens, blocks = held.column("doc").combine_chunks().cast(kind), held.column("len").to_numpy(), held.column("block").to_numpy()
    columns = held.column("tokens").combine_chunks().flatten()  # a list of tokens for each document and column
    size = pc.list_value_length(columns).to_numpy(zero_copy_only=False)
    words, owner = columns.flatten().dictionary_encode(), np.repeat(np.arange(len(size)), size)
    width = len(size) // len(doc)
    at = (owner % width) * GAP + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    by_term = pc.sort_indices(words.dictionary).to_numpy()
    terms, rank = words.dictionary.take(pa.array(by_term)), np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    key = rank[words.indices.to_numpy()] * len(doc) + owner // width
    order = np.argsort(key, kind="stable")  # places of a term in a document stay in order
    key, at = key[order], at[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each term and document
    term, who = key[first] // len(doc), key[first] % len(doc)
    tf = np.diff(first, append=len(key)).astype(np.int32)
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    head = np.flatnonzero(np.diff(term * (blocks[-1] + 1) + blocks[who], prepend=-1))  # of each term and block
    ends = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(ends(head, len(first)), values)
    numbers = first_block + blocks[who[head]]
    rows = pa.RecordBatch.from_arrays([
        terms.take(pa.array(term[head])), pa.array(numbers), lists(doc.take(pa.array(who))), lists(pa.array(lens[who].astype(np.int32))), lists(pa.array(tf)),
        pa.ListArray.from_arrays(ends(first[head], len(key)), pa.array(steps.astype(np.int32))),
    ], schema=_pack_schema(kind))
    ranges = _ranges_of(terms.to_pylist(), term[head], numbers, cuts)
    order = np.argsort(ranges, kind="stable")
    rows, ranges = rows.take(pa.array(order)), ranges[order]
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    raw = [rows.slice(i, j - i).serialize() for i, j in zip(starts, [*starts[1:], len(ranges)], strict=True)]
    packs = [pa.compress(r, "zstd", asbytes=True) for r in raw]
    return pa.RecordBatch.from_arrays([pa.array(ranges[starts]), pa.array([r.size for r in raw], pa.int64()), pa.array(packs, pa.binary())], ["range", "size", "pack"]), int(blocks[-1]) + 1


def _posting_rows(pack: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """What a pack holds, as rows of POSTINGS."""
    n = pc.list_value_length(pack.column("docs")).to_numpy(zero_copy_only=False)
    head = np.cumsum(n) - n
    tfs, lens, steps = (pack.column(c).flatten().to_numpy() for c in ("tfs", "lens", "places"))
    first = np.cumsum(tfs, dtype=np.int64) - tfs
    run = np.cumsum(steps, dtype=np.int64)
    at = run - np.repeat(run[first] - steps[first], tfs)
    ends = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
    places = pa.ListArray.from_arrays(ends(head, len(first)), pa.ListArray.from_arrays(ends(first, len(at)), pa.array(at.astype(np.int32))))
    return pa.RecordBatch.from_pydict({
        "term": pack.column("term"), "block": pack.column("block"), "n": n.astype(np.int32), "max_tf": np.maximum.reduceat(tfs, head), "min_len": np.minimum.reduceat(lens, head), "tf": np.add.reduceat(tfs.astype(np.int64), head),
        "docs": pack.column("docs"), "lens": pack.column("lens"), "tfs": pack.column("tfs"), "places": places, "range": np.full(len(n), number, np.int32),
    })


def _write_segment(index: Index, tokens: DataFrame) -> dict:
    """Writes docs, postings, terms and ranges; the segment's entry in a manifest.

    A task takes its documents as they lie, some TASK_TOKENS tokens at a time, makes their blocks and postings, and sends a compressed row a range. So neither texts nor unfolded postings are shuffled.
    """
    name = f"segment-{uuid.uuid4().hex}"
    spark, kind = index.spark, index.state["key_type"]
    tokens.write.option("compression", "zstd").parquet(index.at(name, "docs"))
    docs = spark.read.schema(f"doc {kind}, len int, tokens array<array<string>>").parquet(index.at(name, "docs"))
    counted = docs.agg(F.count("*"), F.sum("len"), F.count_if(F.col("doc").isNull())).first()
    n_docs, n_tokens = counted[0], counted[1] or 0
    if counted[2]:
        raise ValueError("a document needs a key")
    entry = {"name": name, "docs": n_docs, "tokens": n_tokens, "dead": 0, "dead_tokens": 0, "graves": []}
    if not n_tokens:
        return entry
    ranges = max(1, -(-n_tokens // index.state["range_tokens"]))
    cuts, most_docs, most_tokens, key_type = _cuts(docs, ranges, n_tokens), BLOCK, TASK_TOKENS, to_arrow_type(docs.schema["doc"].dataType)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 32  # the files of a table are dealt to tasks in one way, so a task that runs again gives its blocks their numbers again
        for batch in batches:
            ends = np.cumsum(batch.column("len").to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, most_tokens - n + (ends[at - 1] if at else 0), "right")))
                held.append(batch.slice(at, to - at))
                n, at = n + int(ends[to - 1]) - (int(ends[at - 1]) if at else 0), to
                if n >= most_tokens or at < batch.num_rows:
                    out, blocks = _packs(pa.Table.from_batches(held), block, cuts, most_docs, max(1, most_tokens // 4), key_type)
                    held, n, block = [], 0, block + blocks
                    yield out
        if held:
            yield _packs(pa.Table.from_batches(held), block, cuts, most_docs, max(1, most_tokens // 4), key_type)[0]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _pack_schema(key_type)
        for batch in batches:
            for number, size, pack in zip(*(batch.column(c) for c in ("range", "size", "pack")), strict=True):
                yield _posting_rows(pa.ipc.read_record_batch(pa.decompress(pack.as_buffer(), size.as_py(), "zstd"), schema), number.as_py())

    packs = docs.filter("len > 0").mapInArrow(packed, "range int, size bigint, pack binary").repartitionById(ranges, "range")
    rows = packs.mapInArrow(unpacked, POSTINGS.format(kind=kind)).sortWithinPartitions("range", "term", "block")
    rows.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("range").parquet(index.at(name, "postings"))
    heads = spark.read.schema("term string, n int, tf bigint, range int").parquet(index.at(name, "postings"))
    heads.groupBy("range", "term").agg(F.sum("n").alias("df"), F.sum("tf").alias("tf")).repartition("range").sortWithinPartitions("range", "term").write.partitionBy("range").parquet(index.at(name, "terms"))
    terms = spark.read.schema("term string, range int").parquet(index.at(name, "terms"))
    terms.groupBy("range").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(index.at(name, "ranges"))
    return entry


def _docs(index: Index, segment: dict) -> DataFrame:
    read = index.spark.read.schema(f"doc {index.state['key_type']}, len int, tokens array<array<string>>")
    return read.parquet(index.at(segment["name"], "docs"))


def _graves(index: Index, segments: list[dict]) -> DataFrame | None:
    """segment, doc of the dead."""
    parts = [index.spark.read.schema(f"doc {index.state['key_type']}, len int").parquet(*s["graves"]).select(F.lit(s["name"]).alias("segment"), "doc") for s in segments if s["graves"]]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _alive(index: Index, rows: DataFrame, segments: list[dict]) -> DataFrame:
    """Rows (segment, doc, ..) without those of dead documents."""
    graves = _graves(index, segments)
    if graves is None:
        return rows
    dead = sum(s["dead"] for s in segments)
    return rows.join(F.broadcast(graves) if dead <= FEW else graves, ["segment", "doc"], "left_anti")


def _bury(index: Index, keys: DataFrame) -> list[dict]:
    """The segments' entries with the documents of `keys` (doc) dead: a small table of them beside each segment that has some."""
    out = []
    for s in index.state["segments"]:
        hit = _alive(index, _docs(index, s).select(F.lit(s["name"]).alias("segment"), "doc", "len"), [s]).join(keys, "doc", "left_semi").select("doc", "len")
        path = f"{index.at(s['name'], 'graves')}/{uuid.uuid4().hex}"
        hit.write.parquet(path)
        n, tokens = index.spark.read.schema(hit.schema).parquet(path).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        out.append(s | {"dead": s["dead"] + n, "dead_tokens": s["dead_tokens"] + tokens, "graves": [*s["graves"], path]} if n else s)
    return out


def add(index: Index, docs: DataFrame, key: str = "object_id") -> Index:
    """A batch of documents as a segment of its own; documents of the same keys are replaced. Then segments of like size are merged, if they are many."""
    new = _write_segment(index, _tokens(docs, key, index.columns))
    if not new["docs"]:
        return _commit(index, index.state) if not index.state["version"] else index
    own = _docs(index, new).select("doc")
    if own.groupBy("doc").count().filter("count > 1").limit(1).count():
        raise ValueError("two documents of a batch have one key")
    old = _bury(index, own) if index.state["segments"] else []
    return merge(_commit(index, index.state | {"segments": [*old, new]}))


def delete(index: Index, keys: DataFrame) -> Index:
    """Without the documents whose key is in `keys` (doc); unknown ones are no error."""
    return _commit(index, index.state | {"segments": _bury(index, keys.select("doc").distinct())})


def merge(index: Index, at: int = MERGE_AT) -> Index:
    """Makes one segment of each `at` or more of like size, without their dead; the others stay as they are. Folders that no manifest names are left for readers that still have an older one."""
    tier = lambda s: max(1, s["docs"] - s["dead"]).bit_length() // TIER.bit_length()
    for size in sorted({tier(s) for s in index.state["segments"]}):
        like = [s for s in index.state["segments"] if tier(s) == size]
        if len(like) >= at:
            parts = [_alive(index, _docs(index, s).withColumn("segment", F.lit(s["name"])), [s]).select("doc", "len", "tokens") for s in like]
            merged = _write_segment(index, reduce(DataFrame.unionByName, parts))
            index = _commit(index, index.state | {"segments": [s for s in index.state["segments"] if s not in like] + [merged]})
    return index


class Postings(NamedTuple):
    """What a query reads: rows of its terms in the folders that may have them."""

    rows: DataFrame
    terms: DataFrame
    folders: int


def _overlap(terms: list[str], prefixes: list[str]) -> Column:
    """Ranges (first, last) that may hold some of the terms or of the prefixes' terms."""
    parts = [(F.col("first") <= t) & (F.col("last") >= t) for t in terms]
    parts += [(F.col("last") >= p) & ((F.col("first") < p) | F.col("first").startswith(p)) for p in prefixes]
    return reduce(lambda a, b: a | b, parts)


def postings(index: Index, terms: list[str], prefixes: list[str] = ()) -> Postings:
    """Postings and dictionary rows of the terms and of all terms with the prefixes. The driver reads the ranges of terms that may have them, not more; other folders are not even listed."""
    spark, kind = index.spark, index.state["key_type"]
    schema = POSTINGS.format(kind=kind)
    wanted = F.col("term").isin(*terms) if terms else F.lit(False)
    wanted = reduce(lambda a, p: a | F.col("term").startswith(p), prefixes, wanted)
    live = [s for s in index.state["segments"] if s["tokens"]]
    ranges = [spark.read.schema("range int, first string, last string").parquet(index.at(s["name"], "ranges")).select(F.lit(s["name"]).alias("segment"), "range", "first", "last") for s in live]
    hit = reduce(DataFrame.unionByName, ranges).filter(_overlap(list(terms), list(prefixes))).select("segment", "range").collect() if ranges and (terms or prefixes) else []
    rows, words = [], []
    for s in live:
        numbers = sorted(r.range for r in hit if r.segment == s["name"])
        if numbers:
            read = lambda table, schema: spark.read.schema(schema).option("basePath", index.at(s["name"], table)).parquet(*(f"{index.at(s['name'], table)}/range={n}" for n in numbers)).filter(wanted).withColumn("segment", F.lit(s["name"]))  # noqa: B023, E731
            rows.append(read("postings", schema))
            words.append(read("terms", "term string, df bigint, tf bigint, range int"))
    none = lambda schema: spark.createDataFrame([], schema + ", segment string")
    of = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else none(schema)
    return Postings(of(rows, schema), of(words, "term string, df bigint, tf bigint, range int"), len(hit))


def entries(index: Index, rows: DataFrame, *, places: bool = True) -> DataFrame:
    """segment, block, term, doc, len, tf and, if asked for, places of live documents: a row for each document of posting rows."""
    names = ("docs", "lens", "tfs", *(("places",) if places else ()))
    one = rows.select("segment", "block", "term", F.explode(F.arrays_zip(*names)).alias("e"))
    named = [F.col(f"e.{a}").alias(b) for a, b in zip(names, ("doc", "len", "tf", "places"))]
    return _alive(index, one.select("segment", "block", "term", *named), index.state["segments"])


def tokens(index: Index, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
    """term, doc, column, pos: a row for each token that is one of the terms or has one of the prefixes; what search.match() and its like work on."""
    found = entries(index, postings(index, terms, prefixes).rows).select("term", "doc", F.explode("places").alias("at"))
    names = F.array(*map(F.lit, index.columns))
    return found.select("term", "doc", F.get(names, F.floor(F.col("at") / GAP).cast("int")).alias("column"), (F.col("at") % GAP).alias("pos"))


def documents_with(index: Index, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
    """term, doc: as tokens(), a row for each term of a document; places are not read."""
    return entries(index, postings(index, terms, prefixes).rows, places=False).select("term", "doc")


def dictionary(index: Index) -> DataFrame:
    """term, tf, df over live documents: from the segments' dictionaries, less what their dead documents have."""
    spark, parts = index.spark, []
    for s in (s for s in index.state["segments"] if s["tokens"]):
        parts.append(spark.read.schema("term string, df bigint, tf bigint").parquet(index.at(s["name"], "terms")).select("term", "tf", "df"))
        if s["dead"]:
            graves = _graves(index, [s]).select("doc")
            dead = _docs(index, s).join(F.broadcast(graves) if s["dead"] <= FEW else graves, "doc", "left_semi").select(F.explode(F.flatten("tokens")).alias("term"), "doc")
            parts.append(dead.groupBy("term", "doc").agg(F.count("*").alias("n")).groupBy("term").agg((-F.sum("n")).alias("tf"), (-F.count("*")).alias("df")))
    all_parts = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "term string, tf bigint, df bigint")
    return all_parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).filter("df > 0")


def _frequencies(index: Index, found: Postings) -> DataFrame:
    """term, df of the terms that a query reads."""
    if any(s["dead"] for s in index.state["segments"]):
        return entries(index, found.rows, places=False).groupBy("term").agg(F.count("*").alias("df"))
    return found.terms.groupBy("term").agg(F.sum("df").alias("df"))


# --- phrases and near groups ---


def _starts(phrase: Phrase, columns: tuple[str, ...], slot: dict) -> Column:
    """Places where a phrase starts: the places of its first term, met with those of each further one moved back."""
    names = [slot[t, phrase.prefix and j == len(phrase.terms) - 1] for j, t in enumerate(phrase.terms)]
    back = lambda name, j: F.transform(name, lambda p: p - j)
    found = reduce(F.array_intersect, [back(n, j) for j, n in enumerate(names)])
    if phrase.column is not None:
        at = columns.index(phrase.column)
        found = F.filter(found, lambda p: (p >= at * GAP) & (p < (at + 1) * GAP))
    return F.filter(found, lambda p: p % GAP == 0) if phrase.initial else found


def _near(near: Near, starts: dict[Phrase, str]) -> Column:
    first, *others = near.phrases

    def close(i: Column, p: Phrase) -> Column:
        gap = lambda j: F.when(j > i, j - i - len(first.terms)).otherwise(i - j - len(p.terms))
        return F.exists(starts[p], lambda j: (j != i) & (gap(j) >= 0) & (gap(j) <= near.between))

    return F.exists(starts[first], lambda i: reduce(lambda a, b: a & b, (close(i, p) for p in others), F.lit(True)))


def matched(index: Index, *, all: tuple = (), any: tuple = (), none: tuple = ()) -> DataFrame:  # noqa: A002
    """doc, len, counts, hit as search.matched() has them, for the documents that have a term of the query; no other is looked at."""
    phrases, unwanted = phrases_of((*all, *any)), phrases_of(none)
    exact = sorted({t for p in phrases + unwanted for j, t in enumerate(p.terms) if not (p.prefix and j == len(p.terms) - 1)})
    prefixes = sorted({p.terms[-1] for p in phrases + unwanted if p.prefix})
    slot = {(t, False): f"is_{i}" for i, t in enumerate(exact)} | {(t, True): f"begins_{i}" for i, t in enumerate(prefixes)}
    nowhere = F.array().cast("array<int>")
    places = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("places"))), nowhere).alias(slot[t, False]) for t in exact]
    places += [F.array_sort(F.flatten(F.collect_list(F.when(F.col("term").startswith(t), F.col("places"))))).alias(slot[t, True]) for t in prefixes]
    rows = entries(index, postings(index, exact, prefixes).rows).groupBy("segment", "doc").agg(F.max("len").cast("long").alias("len"), *places)
    at = {p: f"starts_{i}" for i, p in enumerate(dict.fromkeys(phrases + unwanted))}
    rows = rows.select("doc", "len", F.explode(F.array(F.struct(*(_starts(p, index.columns, slot).alias(n) for p, n in at.items())))).alias("s")).select("doc", "len", "s.*")
    said = lambda part: _near(part, at) if isinstance(part, Near) else F.size(at[part]) > 0
    hit = reduce(lambda a, b: a & b, map(said, all), F.lit(True))
    hit = hit & reduce(lambda a, b: a | b, map(said, any)) if any else hit
    hit = hit & ~reduce(lambda a, b: a | b, map(said, none)) if none else hit
    return rows.select("doc", "len", F.array(*(F.size(at[p]) for p in phrases)).alias("counts"), hit.alias("hit"))


def ranked(index: Index, found: DataFrame) -> DataFrame:
    """doc, rank of matched()'s hits. In how many documents each phrase stands is counted first, from the same postings."""
    n = found.filter(F.size("counts") > 0).agg(F.max(F.size("counts"))).first()[0] or 0
    ns = found.agg(*(F.count_if(F.col("counts")[i] > 0).alias(f"n{i}") for i in range(n))).first() if n else ()
    parts = (bm25_part(F.lit(ns[i]), F.col("counts")[i], F.col("len"), F.lit(index.n_docs), F.lit(index.mean_length)) for i in range(n))
    return found.filter("hit").select("doc", sum(parts, F.lit(0.0)).alias("rank"))


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """doc, rank of all documents with any of the terms; neither places nor other terms are read."""
    found = postings(index, sorted({*terms}))
    rows = entries(index, found.rows, places=False).join(F.broadcast(_frequencies(index, found)), "term")  # a row a term
    part = bm25_part(F.col("df"), F.col("tf"), F.col("len"), F.lit(index.n_docs), F.lit(index.mean_length))
    return rows.groupBy("doc").agg(F.sum(part).alias("rank"))


# --- the best few ---


class Best(NamedTuple):
    """rows: query_id, doc, rank, place. needed: query_id, segment, block of the blocks that were scored. blocks: all that hold a term, as many columns and bound."""

    rows: DataFrame
    needed: DataFrame
    blocks: DataFrame


def _best(rows: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def top_k(index: Index, queries: DataFrame, limit: int) -> Best:
    """The best `limit` documents with any term of each query (query_id, term); a batch of at most some thousand terms.

    The heads of blocks give a bound on what any of their documents can score. The `limit` blocks of the highest bounds hold at least as many documents: the last of their best is what a document must reach, so blocks
    whose bound stays below are left out, and no document of them is unfolded. Ties go to the smaller key, so a block that only just reaches the mark is scored.
    """
    asked = queries.select("query_id", "term").distinct()
    found = postings(index, sorted(r.term for r in asked.select("term").distinct().collect()))
    words = F.broadcast(asked.join(F.broadcast(_frequencies(index, found)), "term"))  # a row a query and term
    n_docs, mean = F.lit(index.n_docs), F.lit(index.mean_length)
    bound = F.sum(-bm25_part(F.col("df"), F.col("max_tf"), F.col("min_len"), n_docs, mean)).alias("bound")
    blocks = found.rows.select("segment", "block", "term", "max_tf", "min_len").join(words, "term").groupBy("query_id", "segment", "block").agg(bound)

    def scored(chosen: DataFrame) -> DataFrame:
        rows = entries(index, found.rows.join(chosen.select("segment", "block").distinct(), ["segment", "block"], "left_semi"), places=False)
        part = bm25_part(F.col("df"), F.col("tf"), F.col("len"), n_docs, mean)
        met = rows.join(words, "term").join(chosen, ["query_id", "segment", "block"], "left_semi")
        return _best(met.groupBy("query_id", "segment", "doc").agg(F.sum(part).alias("rank")).drop("segment"), limit)

    first = blocks.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))).filter(F.col("n") <= limit)
    mark = scored(first.select("query_id", "segment", "block")).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("mark"))
    floor = F.broadcast(mark.filter(F.col("n") == limit).select("query_id", (-F.col("mark") * (1 - 1e-9)).alias("floor")))  # a row a query
    needed = blocks.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("floor"))).select("query_id", "segment", "block")
    return Best(scored(needed), needed, blocks)


def search_many(index: Index, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, doc, rank, place."""
    return top_k(index, queries, limit).rows


def search_page(index: Index, limit: int, *, all: tuple = (), any: tuple = (), none: tuple = ()) -> DataFrame:  # noqa: A002
    """The best documents that a query of phrases and near groups finds, with rank, place and has_more; a query without parts gives an empty page."""
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 rows")
    words = [p.terms[0] for p in any if isinstance(p, Phrase) and len(p.terms) == 1 and not (p.prefix or p.column or p.initial)]
    if any and len(words) == len(any) and not all and not none:  # only words: blocks can be left out
        asked = index.spark.createDataFrame([(0, w) for w in words], "query_id int, term string")
        found = top_k(index, asked, limit + 1).rows.select("doc", "rank")
    elif all or any:
        found = ranked(index, matched(index, all=all, any=any, none=none))
    else:
        found = index.spark.createDataFrame([], f"doc {index.state['key_type']}, rank double")
    found = found.orderBy("rank", "doc").limit(limit + 1)
    order = Window.orderBy("rank", "doc")  # over limit + 1 rows
    return found.withColumn("place", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("place") <= limit)
