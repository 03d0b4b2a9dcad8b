"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are packed, in the partitions that hold them, into blocks of neighbouring rows: a matrix (the forward index), its ids and the
largest and smallest value of each term (component). A cell is a bundle of query chunks and a group of blocks; all cells are made, each in one task. There, each query's blocks are
put in order of an upper bound of their scores, the sum over terms of query value times block maximum (minimum where the query is
negative), and are scored until the bound falls below the query's k-th score so far. Each bundle meets one group first, whose k-th scores are the floor that its
queries bring to all other groups: a block whose bound is below it is not scored anywhere. The k best of each group then
meet per query. Bundles and groups have about GROUP_ROWS rows each, so the number of cells grows with the table and the queries, but no cell does.

Components become floor(scale * x), x as a double. Vectors that are null or hold null or non-finite components take no part; vectors of another
length than the query's don't score with it. Ties go to the smaller id; rows with equal ids count as one row's copies only if
they are equal in id: the query's own id is never its candidate. Scores beyond a 64-bit integer are put to its end.
An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 256
QUERY_ROWS = 1024
GROUP_ROWS = 16384
K = 5
_BLOCK = "dim int, ids binary, values binary, high binary, low binary"


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of bigint): the rows that take part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows of one length, in order of id within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            out: list[tuple] = []
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                own = own[np.argsort(ids[own], kind="stable")]
                for at in range(0, len(own), size):
                    some = own[at : at + size]
                    m = flat[starts[some][:, None] + np.arange(dim)].astype("<i8")
                    high, low = (m.max(0), m.min(0)) if dim else (m[:1], m[:1])
                    out.append((int(dim), ids[some].astype("<i8").tobytes(), m.tobytes(), high.tobytes(), low.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["dim", "ids", "values", "high", "low"])

    return rows.mapInArrow(run, _BLOCK)


def _scores(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats while every sum stays below 2**53, else in unbounded integers."""
    if queries.size == 0 or matrix.size == 0:
        return np.zeros((len(queries), len(matrix)), np.int64)
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(matrix.astype(float)).max()) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ matrix.astype(np.float64).T).astype(np.int64)
    wide = queries.astype(object) @ matrix.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(values: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(values, "<i8").reshape(rows, dim)


def search_cell(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, ...]], k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score): the k best of the blocks for each query, by the block order and stop rule above.

    `floor` is a score for each query that k rows of the table are known to reach; rows below it may be left out.
    """
    names, q = queries
    floor = np.full(len(q), np.iinfo(np.int64).min) if floor is None else floor
    plus, minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    bounds = np.stack([plus @ high.astype(np.float64) + minus @ low.astype(np.float64) for _, _, high, low in blocks], 1)
    bounds += np.abs(bounds) * 1e-9  # rounding never lowers a bound
    order = np.argsort(-bounds, 1, kind="stable")
    score, owner = (np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), np.iinfo(np.int64).max))
    filled = np.zeros((len(q), k), bool)
    active = np.arange(len(q))
    for step in range(len(blocks)):
        ahead = bounds[active, order[active, step]]
        active = active[~((ahead < floor[active]) | filled[active, k - 1] & (ahead < score[active, k - 1]))]
        if not len(active):
            break
        for at in np.unique(order[active, step]):
            some = active[order[active, step] == at]
            ids, matrix, _, _ = blocks[at]
            s = _scores(q[some], matrix)
            own = ids[None, :] == names[some][:, None]
            s_all = np.concatenate([score[some], s], 1)
            i_all = np.concatenate([owner[some], np.broadcast_to(ids, s.shape)], 1)
            ok = np.concatenate([filled[some], ~own], 1)
            pick = np.lexsort((i_all, -s_all.astype(np.float64) if np.abs(s_all[ok]).max(initial=0) < 2**53 else ~s_all, ~ok), axis=1)[:, :k]
            rows = np.arange(len(some))[:, None]
            score[some], owner[some], filled[some] = s_all[rows, pick], i_all[rows, pick], ok[rows, pick]
    r, c = np.nonzero(filled)
    return list(zip(names[r].tolist(), owner[r, c].tolist(), score[r, c].tolist(), strict=True))


def cells(vectors: DataFrame, queries: DataFrame, *, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK_ROWS, chunk: int = QUERY_ROWS, group: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Chunks of queries and blocks of rows, each with g and bundle, and the number of groups: every bundle of queries meets every group of blocks."""
    rows, wanted = vectors.count(), queries.count()  # two numbers: how many groups and bundles there are
    groups = max(1, min(-(-rows // block), max(-(-rows // group), 12)))
    bundles = max(1, -(-wanted // group))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = packed(quantised(vectors, scale, key, vector), block).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # rows are dealt out in turn, so that bundles, which are partitions, are of a size
    asked = packed(quantised(queries, scale, key, vector).repartition(bundles), chunk).withColumn("bundle", F.spark_partition_id())
    return asked.select("dim", "ids", "values", "bundle", every(groups).alias("g")), blocks.select("*", every(bundles).alias("bundle")), groups


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK_ROWS, chunk: int = QUERY_ROWS, group: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` for each row of `queries`."""
    asked, blocks, groups = cells(vectors, queries, scale=scale, key=key, vector=vector, block=block, chunk=chunk, group=group)

    def matrices(rows: pd.DataFrame, dim: int) -> list[tuple[np.ndarray, ...]]:
        own = rows[rows.dim == dim]
        return [(np.frombuffer(b.ids, "<i8"), _matrix(b.values, len(b.ids) // 8, dim), np.frombuffer(b.high, "<i8")[:dim], np.frombuffer(b.low, "<i8")[:dim]) for b in own.itertuples()]

    def raise_floor(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in left.itertuples():
            names, parts = np.frombuffer(q.ids, "<i8"), matrices(right, int(q.dim))
            floor = np.full(len(names), np.iinfo(np.int64).min)
            scores: dict[int, list[int]] = {}
            for query, _, score in search_cell((names, _matrix(q.values, len(names), int(q.dim))), parts, k) if parts else []:
                scores.setdefault(query, []).append(score)
            for i, query in enumerate(names.tolist()):
                # a query id on several rows has the scores of all: then nothing is known of each
                if len(scores.get(query, ())) == k:
                    floor[i] = min(scores[query])
            out.append((q.dim, q.ids, q.values, floor.astype("<i8").tobytes(), q.bundle))
        return pd.DataFrame(out, columns=["dim", "ids", "values", "floor", "bundle"])

    def cell(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for q in left.itertuples():
            names, parts = np.frombuffer(q.ids, "<i8"), matrices(right, int(q.dim))
            if parts:
                found += search_cell((names, _matrix(q.values, len(names), int(q.dim))), parts, k, np.frombuffer(q.floor, "<i8"))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    first = F.col("g") == F.pmod(F.col("bundle"), F.lit(groups))
    known = asked.filter(first).groupBy("g", "bundle").cogroup(blocks.filter(first).groupBy("g", "bundle")).applyInPandas(raise_floor, "dim int, ids binary, values binary, floor binary, bundle int")
    asked = known.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    part = asked.groupBy("g", "bundle").cogroup(blocks.groupBy("g", "bundle")).applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
