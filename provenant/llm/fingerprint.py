"""Document fingerprints: quartile digests of hashed byte triplets.

The triplets of a text's UTF-8 bytes (in windows of four: bytes 0-1-2, 0-1-3 and 0-2-3) are hashed into 256 buckets and counted.
Each bucket is written as the quartile its count falls in, two bits of it; a byte each for the length on a
logarithmic scale, the spread of the quartiles and a check sum of the bytes come before. The difference of two digests
is a sum over the buckets' quartile steps and the differences of the head, each bounded; likeness is 1 minus its share of the
most it can be, so 1 for equal digests.

Null texts count as empty; the empty text and texts of fewer than three bytes have a digest with no counts, equal for equal
texts by the check sum. Rows that share a key (or have none: they come last) follow one another in the order of a hash of their texts; a key that a great many rows share
is cut by that hash into as many ranges as it needs. Equal rows are one another's neighbours. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: Bytes of text in one range of keys, about, and the ranges that a small table has at least.
PART_BYTES = 32 << 20
LEAST_PARTS = 24
_LEAST_TIE = -(1 << 31)
#: Bytes counted at a time, so that a very long text needs no more memory.
BLOCK = 1 << 20
#: Most that each part may add to a difference.
MOST_LENGTH, MOST_SPREAD, MOST_CHECK = 400, 40, 8
_MOST = 6 * BUCKETS + MOST_LENGTH + MOST_SPREAD + MOST_CHECK
#: Random odd multipliers for the places in a window, from a rule.
_FACTORS = np.random.default_rng(29).integers(1 << 20, 1 << 31, size=(3, 3), dtype=np.uint32) | np.uint32(1)
_PLACES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def _counts(data: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data[at : at + BLOCK + 3], np.uint8)
        for factors, places in zip(_FACTORS, _PLACES, strict=True):
            n = min(BLOCK, len(b) - places[2])
            if n <= 0:
                continue
            h = _TABLES[factors[0]][b[places[0] : places[0] + n]]
            h = h + _TABLES[factors[1]][b[places[1] : places[1] + n]]
            h += _TABLES[factors[2]][b[places[2] : places[2] + n]]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


_TABLES = {f: np.arange(1, 257, dtype=np.uint32) * f for f in _FACTORS.ravel()}


def digest(data: bytes) -> str:
    """Head (length, spread, check: a byte each) and 512 bits of quartiles, in hex."""
    counts = _counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, round(12 * math.log1p(len(data))))
    spread = round(15 * (q1 + q2) / (2 * q3)) * 16 + round(15 * q1 / q3) if q3 else 0
    return (bytes([length, min(spread, 255), hashlib.md5(data).digest()[0]]) + packed.astype(np.uint8).tobytes()).hex()


#: Bounded cost of one bucket's step of quartiles: opposite ends count double.
_STEP = np.array([0, 1, 2, 6])


def _unpack(hexed: str) -> tuple[bytes, np.ndarray]:
    raw = bytes.fromhex(hexed)
    packed = np.frombuffer(raw, np.uint8, offset=3)
    return raw[:3], ((packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most _MOST."""
    (head_a, codes_a), (head_b, codes_b) = _unpack(a), _unpack(b)
    steps = int(_STEP[np.abs(codes_a - codes_b)].sum())
    length = min(MOST_LENGTH, 16 * abs(head_a[0] - head_b[0]))
    spread = min(MOST_SPREAD, 2 * (abs((head_a[1] >> 4) - (head_b[1] >> 4)) + abs((head_a[1] & 15) - (head_b[1] & 15))))
    return steps + length + spread + MOST_CHECK * (head_a[2] != head_b[2])


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / _MOST


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, fingerprint: one row for each row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "fingerprint": pa.array([digest((t or "").encode()) for t in batch.column(1).to_pylist()], pa.string())})

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def edit(text: str, following: str) -> str:
    """`text` with its last third replaced by the start of `following`."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranges(keyed: DataFrame, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (key, tie) of all ranges but the first, so that a range has about `part_bytes` bytes of text; ties are uniform hashes of 32 bits.

    The driver sees a few numbers a range: quantiles of the keys, then the bytes between them.
    """
    total = keyed.agg(F.sum("bytes").alias("bytes")).first()[0] or 0
    fine = 4 * max(LEAST_PARTS, -(-total // part_bytes))
    quantiles = keyed.agg(F.percentile_approx("k", [i / fine for i in range(1, fine)], 20 * fine).alias("b")).first()[0] or []
    often = {a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b}  # keys that a great many rows share get a range of their own
    cuts = sorted({*quantiles, *(k + 1 for k in often if k < (1 << 63) - 1)})
    rows = _placed(keyed, np.array(cuts, np.int64), np.full(len(cuts), _LEAST_TIE)).groupBy("part").agg(F.sum("bytes").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most"))
    found: list[tuple[int, int]] = []
    size = 0
    target = min(part_bytes, max(1, total // LEAST_PARTS))
    for _, here, least, most in sorted(map(tuple, rows.collect())):
        if found and size + here <= target:
            size += here
            continue
        found.append((least, _LEAST_TIE))
        size = here
        if least == most and here > target:  # one key: ranges of its ties
            pieces = -(-here // target)
            found += [(least, _LEAST_TIE + (i << 32) // pieces) for i in range(1, pieces)]
            size = target
    bounds = found[1:]
    return np.array([k for k, _ in bounds], np.int64), np.array([t for _, t in bounds], np.int64)


def _placed(rows: DataFrame, keys: np.ndarray, ties: np.ndarray) -> DataFrame:
    """`rows` (k, tie, ...) with part: how many of the bounds, which are in order, are not above (k, tie)."""
    shipped = rows.sparkSession.sparkContext.broadcast((keys, ties))  # two numbers a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, tie = shipped.value
        twice = np.unique(bound[1:][bound[1:] == bound[:-1]])
        for b in batches:
            k, t = (b.column(i).to_numpy() for i in (0, 1))
            part = np.searchsorted(bound, k, "right")
            for hot in twice:
                own, low = k == hot, np.searchsorted(bound, hot, "left")
                part[own] = low + np.searchsorted(tie[bound == hot], t[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=[*b.schema.names, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, part int")


def with_following(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """`key`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The document that follows is the next one by falling key (null keys last), after the last the first. Each range of keys is
    sorted in a task of its own; the first row of each range also goes, as a guest, to the end of the range before it, so that no task
    needs another's rows. Texts move once, compressed. The driver sees a few numbers a range.
    """
    low = -(1 << 63)
    kind = docs.schema[key].dataType.simpleString()
    tie = F.hash("text").cast("long")
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("k"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    light = keyed.select("k", tie.alias("tie"), F.octet_length("text").cast("long").alias("bytes"))
    bounds = ranges(light, part_bytes)
    tops = [(p, (k, t)) for p, k, t in sorted(map(tuple, _placed(light, *bounds).groupBy("part").agg(F.max(F.struct("k", "tie")).alias("top")).select("part", "top.k", "top.tie").collect()))] or [(0, (low, 0))]
    # the range that ends before a range's first row is the next higher one that has rows
    hosts = docs.sparkSession.sparkContext.broadcast({top: (part, tops[(i + 1) % len(tops)][0]) for i, (part, top) in enumerate(tops)})
    place = {part: i for i, (part, _) in enumerate(tops)}
    places = docs.sparkSession.sparkContext.broadcast(place)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        guests: set[tuple[int, int]] = set()
        for b in batches:
            k, name, ties, texts, parts = b.columns
            rows, to, guest = list(range(b.num_rows)), [places.value[p] for p in parts.to_pylist()], [0] * b.num_rows
            for i, first in enumerate(zip(k.to_pylist(), ties.to_pylist(), strict=True)):
                if first in hosts.value and first not in guests:
                    guests.add(first)
                    rows.append(i)
                    to.append(places.value[hosts.value[first][1]])
                    guest.append(1)
            packed = pa.array([press.compress(t.encode()) for t in texts.to_pylist()], pa.binary())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest, pa.int32()), k.take(at), ties.take(at), name.take(at), packed.take(at)], names=["part", "guest", "k", "tie", "id", "text"])

    marked = _placed(keyed.select("k", tie.alias("tie"), "id", "text"), *bounds).select("k", "id", "tie", "text", "part")
    dealt = (
        marked.mapInArrow(shrink, f"part int, guest int, k bigint, tie bigint, id {kind}, text binary")
        .repartitionById(len(tops), F.col("part"))
        .sortWithinPartitions("part", "guest", F.desc("k"), F.desc("tie"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        now = None  # (part, id, text, fingerprint) that waits for the row after it
        over = None  # the range that has met its guest
        for b in batches:
            out: list[tuple] = []
            for place, guest, _, _, name, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if guest and (over == place or now is None or now[0] != place):
                    continue
                body = expand.decompress(packed).decode()
                print_ = digest(body.encode())
                if now is not None and now[0] == place:
                    out.append(_row(now, body, print_))
                now, over = (None, place) if guest else ((place, name, body, print_), over)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (b.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(compare, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(now: tuple, following: str, following_print: str) -> tuple:
    _, name, body, own = now
    changed = edit(body, following).encode()
    edited = digest(changed)
    return name, len(body), hashlib.sha256(changed).hexdigest(), own, edited, likeness(own, edited), likeness(own, following_print)
