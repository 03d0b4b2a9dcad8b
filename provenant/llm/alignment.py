"""Alignment of two tokenizers' tokens over the same texts, and how often two ids are linked in a corpus.

Every text is encoded whole by both: a byte-level vocabulary (A) over a space and the text, and a vocabulary of pieces (B), which puts the space there itself. Where both vocabularies have a token
that begins with a space at the same byte, all tokens before end together: such verified shared ends cut a text into windows of a word or so. A window is two tuples of ids, and what
they say (groups of tokens between shared ends, links of tokens that end together) is worked out once for each pair of tuples and remembered. Encoding itself is remembered for the stretches between
single spaces, which neither vocabulary's merges cross.

The corpus-wide number of links between two ids is a count over all texts. Pairs that have more than a `1 / MOST_FREQUENT` share of all links are at most MOST_FREQUENT: these are broadcast, the others, none of which is a
hot key, are joined by a shuffle.

Null and empty texts have no tokens, nor have texts that the vocabularies don't give back alike, byte by byte (B turns U+2581 to a space, for one). Rows are counted as they are, repeated ones repeatedly, whatever
their key; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import FEW_ROWS, free, held, written

#: Entries that a Python worker remembers of stretches and of windows; a full table starts anew, and the one before it stays readable.
STRETCHES, WINDOWS = 240_000, 240_000
#: Characters of a stretch, bytes of a window's ids up to which they are remembered: so the tables are bounded in bytes, too.
LONG_STRETCH, LONG_WINDOW = 64, 256
#: Rows of a batch that tasks give back, texts whose new stretches are encoded together.
ROWS, TOGETHER = 250, 250
#: Most pairs of ids that are broadcast when not all of them are few.
MOST_FREQUENT = 500_000
#: The pattern by which the byte-level format splits texts.
SPLIT = public_tokenizers.PATTERN
#: A space between two characters that are no white space: both vocabularies begin a token with it.
_BETWEEN = re.compile(r" (?=\S)(?<=\S )")


class Byte:
    """A byte-level vocabulary in the format of `tokenizers`. Where its merges are in the order of their ids and it splits texts by the usual pattern, `tiktoken` encodes with it: the same ids, several times as fast."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text("utf-8"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a vocabulary shows as themselves; others as 256 and up
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        of = lambda token: bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        ids = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = of(token)
        self.quick = self._quick(file, of)
        if self.quick is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True

    def _quick(self, file: dict, of):
        split, model = file["pre_tokenizer"] or {}, file["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and file["normalizer"] is None and not model.get("dropout") and not model.get("ignore_merges")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocab.get(x + y, -1) for x, y in merges]
        # ids as ranks say the same as the list of merges if they ascend along it, after the single bytes
        if not plain or len(vocab) != 256 + len(merges) or made != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={of(t): i for t, i in vocab.items()}, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick(" " + t) for t in texts]
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Piece:
    """A vocabulary of pieces in the format of `sentencepiece`; it puts a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Kept(dict):
    """A table of at most `most` entries; a full one starts anew, and the one before it stays readable."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def of(self, keys: list, make: Callable[[list], list], keep: Callable[[object], bool]) -> list:
        """The entry of each of `keys`; what is in neither table is made together."""
        out = list(map(self.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        older = self.older.get
        new = {k: older(k) for k in map(keys.__getitem__, missing)}
        unknown = [k for k, x in new.items() if x is None]
        if unknown:
            new.update(zip(unknown, make(unknown)))
        for i in missing:
            out[i] = new[keys[i]]
        kept = [k for k in new if keep(k)]
        if len(self) + len(kept) > self.most:
            self.older = dict(self)
            self.clear()
        self.update((k, new[k]) for k in kept[: self.most])
        return out


class Aligner:
    def __init__(self, a: Byte, b: Piece):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (a, b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in x.bytes]) for x in (a, b))
        self.windows, self.stretches = _Kept(WINDOWS), _Kept(STRETCHES)
        # each id with what follows it in a group: `,` or, as the last one, `|` for A and `;` for B
        self.shown = [f"{i}{end}" for of, ends in ((a, ",|"), (b, ",;")) for i in range(len(of.bytes)) for end in ends]
        self.shown_size = np.array(list(map(len, self.shown)), np.int64)
        # a stretch can be encoded by itself if no piece of B goes on over a space
        self.parted = not any(b" " in t.lstrip(b" ") for t in b.bytes)

    def split(self, text: str) -> list[str]:
        return _BETWEEN.split(text) if self.parted else [text]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both, as 32-bit integers, of each text; None where the texts that they give back differ from it."""
        parts = [self.split(t) for t in texts]
        known = iter(self.stretches.of([p for some in parts for p in some], self._made, lambda p: len(p) <= LONG_STRETCH))
        out = []
        for text, some in zip(texts, parts):
            a, b, same = zip(*islice(known, len(some)))
            a, b = b"".join(a), b"".join(b)
            out.append((a, b) if all(same) or self._text(a, self.a) == self._text(b, self.b) == (" " + text).encode() else None)
        return out

    def _made(self, stretches: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both vocabularies, and whether they give the stretch back. Stretches between single spaces are encoded in one go and cut apart where their bytes end."""
        joined = self._cut(stretches) if self.parted and len(stretches) > 1 and not any(t[0].isspace() or t[-1].isspace() for t in stretches) else None
        if joined is not None:
            return joined
        of_a, of_b, out = self.a.bytes, self.b.bytes, []
        for t, x, y in zip(stretches, self.a.encode(stretches), self.b.encode(stretches)):
            data = (" " + t).encode()
            same = b"".join([of_b[i] for i in y]) == data and b"".join([of_a[i] for i in x]) == data
            out.append((array("i", x).tobytes(), array("i", y).tobytes(), same))
        return out

    def _cut(self, stretches: list[str]) -> list[tuple[bytes, bytes, bool]] | None:
        """As _made(), from one text of all stretches; None if a vocabulary doesn't give it back, so that they must be looked at one by one."""
        whole = " ".join(stretches)
        data = (" " + whole).encode()
        ends = np.cumsum([len(t.encode()) + 1 for t in stretches])
        sides = []
        for of, size in ((self.a, self.size_a), (self.b, self.size_b)):
            (ids,) = of.encode([whole])
            ids = np.array(ids, np.int32)
            if self._text(ids, of) != data:
                return None
            at = np.searchsorted(np.cumsum(size[ids]), ends, "right") * 4
            packed = ids.tobytes()
            sides.append([packed[i:j] for i, j in zip([0, *at[:-1].tolist()], at.tolist())])
        return [(x, y, True) for x, y in zip(*sides)]

    @staticmethod
    def _text(ids: bytes | np.ndarray, of: Byte | Piece) -> bytes:
        return b"".join([of.bytes[i] for i in np.frombuffer(ids, np.int32).tolist()])

    def forget(self) -> None:
        """Empties the tables."""
        for table in (self.stretches, self.windows):
            table.clear()
            table.older.clear()

    def _cuts(self, a: bytes, b: bytes) -> list[tuple[bytes, bytes]]:
        """A text's ids, cut where tokens of both begin with a space at the same byte."""
        starts = []
        for packed, size, space in ((a, self.size_a, self.space_a), (b, self.size_b, self.space_b)):
            ids = np.frombuffer(packed, np.int32)
            begins = np.cumsum(size[ids])
            begins -= size[ids]
            at = np.flatnonzero(space[ids])
            starts.append((begins[at], 4 * at))
        (where_a, at_a), (where_b, at_b) = starts
        _, i, j = np.intersect1d(where_a, where_b, assume_unique=True, return_indices=True)
        i, j = at_a[i].tolist(), at_b[j].tolist()
        if not i or i[0] or j[0]:
            i, j = [0, *i], [0, *j]
        return [(a[p:q], b[r:s]) for p, q, r, s in zip(i, [*i[1:], len(a)], j, [*j[1:], len(b)])]

    def _aligned(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes, int]]:
        """Groups as text, links as 64-bit integers and their number, of each window. Windows end together on both sides, so that all are aligned as one."""
        of_a, of_b = zip(*windows)
        a, b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (of_a, of_b))
        _, i, j = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), assume_unique=True, return_indices=True)
        links = (a[i] << 32 | b[j]).tobytes()
        codes, groups = [], []
        for ids, ends, first in ((a, i, 0), (b, j, 2 * len(self.size_a))):
            last = np.zeros(len(ids), np.int64)
            last[ends] = 1
            codes.append(first + 2 * ids + last)
            groups.append(np.cumsum(last) - last)
        code = np.concatenate(codes)[np.argsort(np.concatenate((2 * groups[0], 2 * groups[1] + 1)), kind="stable")]
        text = "".join(map(self.shown.__getitem__, code.tolist()))
        n_a, n_b = (np.cumsum([len(x) // 4 for x in side]) for side in (of_a, of_b))
        chars = np.cumsum(self.shown_size[code])[n_a + n_b - 1].tolist()
        counts = np.bincount(np.searchsorted(n_a, i, "right"), minlength=len(windows))
        bounds = (8 * np.cumsum(counts)).tolist()
        return [(text[p : q - 1], links[r:t], n) for p, q, r, t, n in zip([0, *chars], chars, [0, *bounds], bounds, counts.tolist())]

    def align(self, texts: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes, int]]:
        """Groups as text, links, number of groups of each text's ids."""
        parts = [self._cuts(*ids) for ids in texts]
        known = iter(self.windows.of([w for some in parts for w in some], self._aligned, lambda w: len(w[0]) + len(w[1]) <= LONG_WINDOW))
        out = []
        for some in parts:
            groups, links, counts = zip(*islice(known, len(some)))
            out.append((";".join(groups), b"".join(links), sum(counts)))
        return out


def align(df: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_a, n_b, n_groups, groups (ids as `a1,a2|b1;a3|b2,b3`), links (array of A's id * 2^32 + B's id, in the order of the text): one row for each row of `df`.

    The vocabularies are read by the tasks from where the parameters say.
    """
    kind = df.schema[key].dataType.simpleString()

    def batch(aligner: Aligner, rows: pa.RecordBatch) -> pa.RecordBatch:
        groups, links, counts = [""] * rows.num_rows, [b""] * rows.num_rows, np.zeros((3, rows.num_rows), np.int64)
        full = [(k, t) for k, t in enumerate(rows.column(1).to_pylist()) if t]
        for at in range(0, len(full), TOGETHER):
            some = full[at : at + TOGETHER]
            ids = [(k, x) for (k, _), x in zip(some, aligner.encode([t for _, t in some])) if x is not None]
            for (k, x), found in zip(ids, aligner.align([x for _, x in ids])):
                groups[k], links[k], n = found
                counts[:, k] = len(x[0]) // 4, len(x[1]) // 4, n
        offsets = np.concatenate(([0], np.cumsum([len(x) // 8 for x in links])))
        flat = pa.array(np.frombuffer(b"".join(links), np.int64))
        columns = [rows.column(0), *map(pa.array, counts), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "n_a", "n_b", "n_groups", "groups", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = held(("alignment", a_file, b_file), lambda: Aligner(Byte(a_file), Piece(b_file)))
        for rows in batches:
            for at in range(0, rows.num_rows, ROWS):
                yield batch(aligner, rows.slice(at, ROWS))
        aligner.forget()  # a task's tables are not kept for what comes after
        free()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n, best: how many links of all texts hold a pair of ids, and whether no A id is linked with its B id more often. Written to the shared folder."""
    counts = written(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")), "links")
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B's vocabulary, whose size is fixed
    return written(counts.join(F.broadcast(most), b == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "link-counts")


def scored(aligned: DataFrame, counts: DataFrame, row: str, few: int = FEW_ROWS, frequent: int = MOST_FREQUENT) -> DataFrame:
    """`row`, n_best, count_sum of each row that has links. `row` tells the rows of `aligned` apart."""
    links = aligned.select(row, F.explode("links").alias("link"))
    total = lambda df: df.groupBy(row).agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    if counts.limit(few + 1).count() <= few:
        return total(links.join(F.broadcast(counts), "link"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // frequent + 1  # at most `frequent` pairs are counted that often
    often, seldom = counts.filter(F.col("n") >= least), counts.filter(F.col("n") < least)
    others = links.join(F.broadcast(often.select("link")), "link", "left_anti")
    parts = total(links.join(F.broadcast(often), "link")).unionByName(total(others.join(seldom.hint("shuffle_merge"), "link")))
    return parts.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(aligned: DataFrame) -> DataFrame:
    """Counts and digests of align()'s rows with what the whole corpus says of their links. The alignment is written once and read by what follows."""
    listed = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = written(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), listed.alias("groups_sha256"), "links"), "aligned")
    sums = scored(kept, link_counts(kept), "row")
    of = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return kept.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", of("n_best"), of("count_sum"), "groups_sha256")
