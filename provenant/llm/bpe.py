"""Byte-level BPE encoding and decoding with a published rank file.

Each match of the splitting pattern is encoded on its own. An automaton over the vocabulary
(bytes mapped to Latin-1) finds the longest token that starts at each byte; a backtracking
search then takes longest tokens and falls back to shorter ones where two neighbours could not
stand next to each other in a merged text. Whether two tokens can is asked once per pair, by
stepping back through the merges that made them: no state on the way may hold a merge across
their border that was due earlier. A sequence all of whose neighbours fit is the one that the merges produce, so the result is exact; a position
that proved unreachable is never tried again, so the work is linear in the text.

Null texts count as empty and give no tokens. Repeated rows and other columns are kept as they are.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import held, map_arrow

#: Entries kept per Python worker. A full cache starts anew; of pieces, the last full one stays readable.
PIECE_CACHE = 80_000
#: Characters of a piece up to which its ids are kept.
LONG_PIECE = 64
PAIR_CACHE = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merge procedure as defined: join the neighbours of least rank, leftmost first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: Texts without a character from here on take the quicker splitter.
_NARROW = 0x250


def splitter(pattern: str):
    """findall() of `pattern`. `re` is twice as fast as `regex` but lacks \\p{L} and \\p{N}: it gets them
    spelt out up to _NARROW, and texts that hold other characters go to `regex`."""
    wide, out, inside = regex.compile(pattern).findall, "", False
    for token in re.findall(r"\\p\{\w+\}|\\.|[\s\S]", pattern):
        if token == r"\s" or token.startswith(r"\p{"):
            member = regex.compile(token).match
            found = "".join(rf"\u{c:04x}" for c in range(_NARROW) if member(chr(c)))
            out += found if inside else f"[{found}]"
        elif token == r"\S":
            member = regex.compile(token).match
            out += "[" + "".join(rf"\u{c:04x}" for c in range(_NARROW) if member(chr(c))) + "]"
        else:
            inside = token == "[" or inside and token != "]"
            out += token
    narrow, other = re.compile(out).findall, re.compile(rf"[^\x00-\u{_NARROW - 1:04x}]").search
    return lambda text: wide(text) if other(text) else narrow(text)


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers. Pieces beyond LONG_PIECE characters are not kept, so entries are small and the table is bounded in bytes, too."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return self._packed(piece)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if (packed := self.older.get(piece)) is not None:
            self[piece] = packed
            return packed
        packed = self[piece] = self._packed(piece)
        return packed

    def _packed(self, piece: str) -> bytes:
        ids = array("I", self.encode(piece.encode("utf-8", "replace")))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = [len(self.tokens.get(rank, b"")) for rank in range(max(self.tokens) + 1)]
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.prefixes: dict[int, int] = {}
        self.split = splitter(pattern)
        self.pieces = _Pieces(self.encode_piece, PIECE_CACHE)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a single byte."""
        if token not in self.made:
            data, earlier = self.tokens[token], {}
            if len(data) > 1:
                earlier = {data[i:j]: r for i in range(len(data)) for j in range(i + 1, len(data) + 1) if (r := self.ranks.get(data[i:j], token)) < token}
            parts = merge_bytes(data, earlier)
            self.made[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        a, b, due = left, right, 1 << 60
        while self.ranks.get(self.tokens[a] + self.tokens[b], due) >= due:
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and a > b:  # the later merge is undone first
                a, due = of_a[1], a
            else:  # of equal merges the right one is later, and one on the border comes before it
                b, due = of_b[0], b + 1
        return False

    def neighbours(self, left: int, right: int) -> bool:
        """fits(), asked once per pair."""
        known = self.pairs.get(key := left << 32 | right)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.fits(left, right)
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of `token`; -1 if there is none."""
        known = self.prefixes.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.prefixes[token] = next((self.ranks[p] for k in range(len(data) - 1, 0, -1) if (p := data[:k]) in self.ranks), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        length, pairs, size = self.length, self.pairs, len(data)
        longest = [0] * size
        for end, token in self.find.iter(data.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # a later end is a longer match
        token, end = longest[0], length[longest[0]]
        out, at, last, blocked = [], 0, -1, set()
        while True:
            if end not in blocked:
                fit = last < 0 or pairs.get(last << 32 | token)
                if fit is None:
                    fit = self.neighbours(last, token)
                if fit:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    end = at + length[token]
                    continue
            token = self.shorter(token)
            if token < 0:
                blocked.add(at)
                if not out:
                    raise ValueError(f"no sequence of tokens makes up {data[:40]!r}")
                end, token = at, out.pop()
                at -= length[token]
                last = out[-1] if out else -1
            else:
                end = at + length[token]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""


def _codec(shipped, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return held(("bpe", pattern, shipped.value[0]), lambda: Codec(shipped.value[1], pattern))


def _ship(df: DataFrame, rank_file: str):
    """The vocabulary has a fixed size (50,256 tokens), whatever the input is."""
    ranks = load_ranks(rank_file)
    return df.sparkSession.sparkContext.broadcast((hash(rank_file), ranks))


def encode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", *, decoded: bool = False) -> DataFrame:
    """`key`, token_ids (BINARY: little-endian unsigned 32-bit ids) and, if asked for, decoded (BINARY).

    One row for each row of `df`; a null text is an empty one. Other columns are not read.
    """
    shipped = _ship(df, rank_file)
    kind = df.schema[key].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shipped, pattern)
        packed = [codec.encode(t) for t in rows.column(1).to_pylist()]
        columns = {key: rows.column(0), "token_ids": pa.array(packed, pa.binary())}
        if decoded:
            columns["decoded"] = pa.array([codec.decode(p) for p in packed], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    return map_arrow(df.select(key, text), batch, f"`{key}` {kind}, token_ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """`key` and decoded (BINARY) from packed ids; null ids decode to no bytes."""
    shipped = _ship(df, rank_file)
    kind = df.schema[key].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shipped, pattern)
        return pa.RecordBatch.from_pydict({key: rows.column(0), "decoded": pa.array([codec.decode(p) for p in rows.column(1).to_pylist()], pa.binary())})

    return map_arrow(df.select(key, ids), batch, f"`{key}` {kind}, decoded binary")


def token_count(ids: str = "token_ids") -> Column:
    return F.expr(f"cast(octet_length({ids}) div 4 as bigint)")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded bytes for each encoded row."""
    return encoded.select(
        "doc_id", token_count().alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
