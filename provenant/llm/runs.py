"""Periodic runs of words in a text: stretches that repeat with a period and can't be extended.

Every run has a Lyndon root: a word that starts somewhere inside it, is the longest Lyndon word from there in the order of words or in its reverse, and is as long as the period. So each
place gives two candidates, from its next smaller suffix in either order, and a candidate is extended to both sides by common extensions: how far the suffixes from both ends of the root agree,
and how far the prefixes before them do. Extensions are asked of suffix trees, one of the words and one of the words reversed, built by Ukkonen's algorithm in linear time; the string depth
of the lowest common ancestor of two leaves is a minimum over the tour of the tree, found in constant time from a table of minima.

A run that is asked for repeats its period at least `LEAST_POWER` times, so each of its words occurs again within that part of its length. Stretches of words that no such run can hold are
known from distances alone; each becomes one mark that equals nothing, and the trees are built over what is left: the cost of trees follows the repeated parts of a text, the result is that of the whole.

Words are `[^\\x20\\x09-\\x0D]+`. Null texts count as empty; a text without words has no runs. A text's trees take about 1 kB a word of its repeated parts while it is worked on, in one task: no text is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import let_go, map_arrow

#: A run has at least this many words, and repeats its period this often.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Rounds in which stretches without runs are looked for; more rounds save work, no result depends on them.
REFINEMENTS = 12


class SuffixTree:
    """The suffix tree of a list of numbers below `width` that ends with a 0 found nowhere else. Leaf k, from 0, is suffix k; the root is node `size`, and inner nodes follow."""

    def __init__(self, s: list[int], width: int):
        self.size, self.width = len(s), width
        depth, edges = self._build(s, width)
        self.depth = np.concatenate((self.size - np.arange(self.size), depth))
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        by = np.argsort(keys)
        self.child = np.fromiter(edges.values(), np.int64, len(edges))[by]
        self.parent, self.letter = np.divmod(keys[by], width)

    def _build(self, s: list[int], width: int) -> tuple[list[int], dict[int, int]]:
        """Ukkonen: letters are added one by one while `left` suffixes wait. Depths of root and inner nodes, and children by node and letter."""
        root = size = self.size
        start, end, link, depth, edges = [0] * (2 * size + 1), [size] * (2 * size + 1), [root] * (2 * size + 1), [0], {}
        new, node, at, length, left = root + 1, root, 0, 0, 0
        get = edges.get
        for i, letter in enumerate(s):
            left += 1
            pending = 0
            while left:
                if not length:
                    at = i
                key = node * width + s[at]
                child = get(key)
                if child is None:
                    edges[key] = leaf = i - left + 1
                    start[leaf] = i
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    begin = start[child]
                    span = end[child] - begin
                    if length >= span:
                        node, at, length = child, at + span, length - span
                        continue
                    split = begin + length
                    if s[split] == letter:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    edges[key] = new
                    start[new], end[new], start[child] = begin, split, split
                    depth.append(left - 1)
                    base = new * width
                    edges[base + s[split]] = child
                    edges[base + letter] = leaf = i - left + 1
                    start[leaf] = i
                    if pending:
                        link[pending] = new
                    pending = new
                    new += 1
                left -= 1
                if node != root:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        return depth, edges

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes in the order of a walk from the root, children by letter or by letter backwards (0 comes first in both), and the depth of each one's parent."""
        size, child, by = self.size, self.child, slice(None)
        if backwards:
            by = np.argsort(self.parent * self.width + (self.width - self.letter) % self.width)
        kids = child[by][::-1].tolist()  # the last is walked first
        ends = (len(kids) - np.searchsorted(self.parent, np.arange(size, len(self.depth) + 1))).tolist()
        walk, stack = [], [size]
        while stack:
            node = stack.pop()
            walk.append(node)
            if node >= size:
                stack += kids[ends[node - size + 1] : ends[node - size]]
        walk = np.array(walk)
        above = np.zeros(len(self.depth), np.int64)
        above[child] = self.depth[self.parent]
        return walk, above[walk]

    def ranks(self, walk: np.ndarray) -> np.ndarray:
        out = np.empty(self.size, np.int64)
        out[walk[walk < self.size]] = np.arange(self.size)
        return out


class Extensions:
    """How many letters two suffixes share: the least depth of a parent between their leaves on the tour, by blocks of BLOCK entries and a table of minima over blocks."""

    BLOCK = 16

    def __init__(self, tree: SuffixTree, walk: np.ndarray, above: np.ndarray):
        n, width = len(walk), self.BLOCK
        self.place = np.empty(tree.size, np.int64)
        self.place[walk[walk < tree.size]] = np.flatnonzero(walk < tree.size)
        rows = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
        rows[:n] = above
        self.rows = rows
        grid = rows.reshape(-1, width)
        self.from_left = np.minimum.accumulate(grid, 1).ravel()
        self.from_right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        step = 1
        while 2 * step <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For suffixes a and b, pairwise different."""
        x, y = self.place[a], self.place[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        first, last = lo // self.BLOCK, hi // self.BLOCK
        out = np.minimum(self.from_right[lo], self.from_left[hi])
        inner = last - first - 1
        level = np.frexp(np.maximum(inner, 0))[1] - 1
        for k in np.unique(level[inner > 0]).tolist():
            here = np.flatnonzero(level == k)
            mins = self.table[k]
            out[here] = np.minimum(out[here], np.minimum(mins[first[here] + 1], mins[last[here] - (1 << k)]))
        same = np.flatnonzero(first == last)
        for at in range(self.BLOCK) if len(same) else ():  # both ends in one block
            spot = np.minimum(lo[same] + at, hi[same])
            out[same] = self.rows[spot] if at == 0 else np.minimum(out[same], self.rows[spot])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank; the length if there is none."""
    size = len(rank)
    out, stack = [size] * size, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def all_runs(s: np.ndarray, least: int, power: int) -> np.ndarray:
    """start, length, period of each run of `power` periods and `least` letters at least in an array of numbers from 1, by start, then period."""
    n, width = len(s), int(s.max()) + 1
    letters = s.tolist()
    tree = SuffixTree([*letters, 0], width)
    walk, above = tree.tour()
    forward = Extensions(tree, walk, above)
    places, roots = np.arange(n), []
    for rank in (tree.ranks(walk), tree.ranks(tree.tour(backwards=True)[0])):
        to = _next_smaller(rank[:n].tolist())
        roots.append(np.stack((places[to < n], to[to < n])))
    del tree
    i, j = np.unique(np.concatenate(roots, 1), axis=1)
    period, right = j - i, forward.common(i, j)
    keep = right >= (power - 2) * period  # the first root in a run begins within its first period
    i, j, period, right = i[keep], j[keep], period[keep], right[keep]
    left = np.zeros(len(i), np.int64)
    if len(i):
        letters.reverse()
        tree = SuffixTree([*letters, 0], width)
        inside = np.flatnonzero(i > 0)
        left[inside] = Extensions(tree, *tree.tour()).common(n - i[inside], n - j[inside])
    length = left + period + right
    keep = (length >= power * period) & (length >= least)
    return np.unique(np.stack((i[keep] - left[keep], length[keep], period[keep]), 1), axis=0)


def _stretches(can: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of at least `least` true entries."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], can, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _condensed(ids: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that a run could hold, stretches of others as one mark each, renumbered from 1; and where each of the kept words stood (marks: -1).

    A word of a run occurs again at a distance of the period, which is at most the run's length by `power`, so at most that part of the stretch of words that are left around it.
    """
    n = len(ids)
    starts, ends = _stretches(np.bincount(ids)[ids] >= power, least)
    near = np.zeros(n, np.int64)
    for turn in range(REFINEMENTS):
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = ends - starts
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())  # the places that are left
        if not turn:
            of = ids[at]
            by = np.argsort(of.astype(np.uint16) if of.max() < 1 << 16 else of, kind="stable")
            gap = np.where(of[by[1:]] == of[by[:-1]], np.diff(at[by]), n)
            near[at[by]] = np.minimum(np.concatenate(([n], gap)), np.concatenate((gap, [n])))
        can = np.zeros(n, bool)
        can[at] = near[at] <= np.repeat(lengths // power, lengths)
        if can.sum() == len(at):
            break
        starts, ends = _stretches(can, least)
    else:
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([x for a, b in zip(starts.tolist(), ends.tolist()) for x in (np.arange(a, b), [-1])][:-1]).astype(np.int64)
    kept = np.unique(ids[at[at >= 0]], return_inverse=True)[1] + 1
    out = np.empty(len(at), np.int64)
    out[at >= 0] = kept
    out[at < 0] = int(kept.max()) + 1 + np.arange(int((at < 0).sum()))
    return out, at


def periodic_runs(words: list[bytes], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> np.ndarray:
    """start, length, period of the runs of a list of words, by start, then period."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    s, at = _condensed(ids, least, power)
    if not len(s):
        return np.zeros((0, 3), np.int64)
    found = all_runs(s, least, power)
    found[:, 0] = at[found[:, 0]]
    return found


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those of a run that come after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist())


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, runs (array of start, length, period in words; by start, then period), collapsed (the text's words joined by one space, each run cut to its first period).

    One row for each row of `df`, whatever its key; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        let_go()
        found, offsets, texts = [], [0], []
        for t in rows.column(1):
            words = t.as_py().encode("utf-8").split() if t.is_valid else []  # the whitespace of bytes is 0x20 and 0x09-0x0D
            of = periodic_runs(words)
            found.append(of)
            offsets.append(offsets[-1] + len(of))
            texts.append(without_repeats(words, of).decode("utf-8"))
        table = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        spans = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(run))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        return pa.RecordBatch.from_arrays([rows.column(0), runs, pa.array(texts, pa.string())], names=[key, "runs", "collapsed"])

    return map_arrow(df.select(key, text), batch, f"`{key}` {kind}, runs array<{RUN}>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length by period, compared as fractions; of equal ones the first by start, then period. Null without runs."""
    return F.expr(f"aggregate({runs}, cast(null as {RUN}), (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))")


def digests(found: DataFrame) -> DataFrame:
    """Count, strongest run and digests of find_runs()'s rows."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", strongest()).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def spliced(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, text: of every tenth document, by the CRC-32 of its key, the words from some place on repeat with some period; other texts stay. A null key leaves its text as it is."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = (h % 10 == 0) & F.col(text).isNotNull()
    rows = df.select(F.col(key), F.col(text).alias("text"), F.floor(h / 10).alias("g"), F.explode(F.array(F.when(hit, words))).alias("words"))
    n = F.size("words")
    a = F.when(n > 0, F.col("g") % n)
    rows = rows.withColumn("a", a.cast("int")).withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)"))
    again = F.array_join(F.expr("transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p]))"), " ")
    return rows.select(key, F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
