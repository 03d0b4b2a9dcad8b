"""What the first 64 KiB of a WAV file declare; nothing is said of the sound itself."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 64 << 10
FIELDS = ["format_code", "channels", "sample_rate_hz", "byte_rate", "block_align_bytes", "bits_per_sample", "data_declared_bytes"]
SCHEMA = "file string, status string, riff_declared_bytes bigint, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", declared_duration_sec double, issues array<string>"
#: Sample widths in bits that each format code allows.
WIDTHS = {1: (8, 16, 24, 32), 3: (32, 64)}


class Chunk(NamedTuple):
    """One entry of the table of chunks; `body` is as much of it as lies in the prefix."""

    name: bytes
    at: int
    size: int
    body: bytes

    @property
    def end(self) -> int:
        """Where the next chunk begins: bodies of odd size are padded."""
        return self.at + 8 + self.size + self.size % 2


class Layout(NamedTuple):
    """What lies where in a RIFF prefix: its chunks, and what ended the table (None where it reaches the extent)."""

    extent: int
    chunks: list[Chunk]
    stopped: str | None


def layout(data: bytes) -> Layout:
    """The table of chunks, as far as the prefix shows it; nothing is judged here."""
    extent = struct.unpack_from("<I", data, 4)[0] + 8
    chunks: list[Chunk] = []
    at = 12
    while at < extent:
        if extent - at < 8 or at + 8 > len(data):
            return Layout(extent, chunks, "no room" if extent - at < 8 else "out of sight")
        name, size = struct.unpack_from("<4sI", data, at)
        chunk = Chunk(name, at, size, data[at + 8 : at + 8 + size])
        if chunk.end > extent:
            return Layout(extent, chunks, "too large")
        chunks.append(chunk)
        if chunk.end > len(data):
            return Layout(extent, chunks, "cut")
        at = chunk.end
    return Layout(extent, chunks, None)


def _reach(found: Layout) -> list[Chunk]:
    """Chunks up to a format whose fields lie outside the prefix: nothing after it can be read in its light."""
    for i, c in enumerate(found.chunks):
        if c.name == b"fmt " and c.size >= 16 and len(c.body) < min(c.size, 18):
            return found.chunks[: i + 1] if len(c.body) < 16 or c.size == 18 else found.chunks
    return found.chunks


def _fields(chunk: Chunk) -> dict[str, int]:
    return dict(zip(FIELDS, struct.unpack_from("<HHIIHH", chunk.body), strict=False)) if len(chunk.body) >= 16 else {}


#: What each issue makes of the file; others only inform. Of several the first kind in KINDS counts.
KINDS = ("malformed", "unsupported", "size_mismatch", "partial")
WEIGHT = {
    "malformed": "truncated_header invalid_riff_extent truncated_or_trailing_container trailing_bytes truncated_chunk_header chunk_extent_outside_riff duplicate_fmt invalid_fmt_size invalid_format_geometry duplicate_data data_before_fmt unaligned_data_size truncated_chunk_payload missing_required_chunk".split(),
    "unsupported": "unsupported_container unsupported_wave_type unsupported_format unsupported_fmt_extension unsupported_sample_width".split(),
    "size_mismatch": ["provider_size_mismatch"],
    "partial": "header_prefix_incomplete required_header_unobserved".split(),
}


def _format_rules(chunk: Chunk, fields: dict[str, int]) -> dict[str, bool]:
    """Rules on the format chunk alone."""
    if not fields:
        return {"invalid_fmt_size": chunk.size < 16}
    code, bits, align = fields["format_code"], fields["bits_per_sample"], fields["block_align_bytes"]
    frame = fields["channels"] * bits // 8
    return {
        "unsupported_format": code not in WIDTHS,
        "unsupported_sample_width": code in WIDTHS and bits not in WIDTHS[code],
        "unsupported_fmt_extension": chunk.size not in (16, 18) or chunk.size == 18 and any(chunk.body[16:18]),
        "invalid_format_geometry": not all(fields.values()) or bits % 8 != 0 or align != frame or fields["byte_rate"] != fields["sample_rate_hz"] * align,
    }


def probe(prefix: bytes, size: int | None = None, whole: bool = False) -> tuple:
    """status, declared extent, FIELDS, seconds, issue codes. `whole`: the prefix is all of the file; `size`: what its keeper says it has."""
    data, whole = prefix[:PREFIX], whole and len(prefix) <= PREFIX
    beyond = "truncated_header" if whole else "header_prefix_incomplete"  # what is missing at the end of the bytes at hand
    issues = {"prefix_limit": len(prefix) > PREFIX}
    fields: dict[str, int] = {}
    extent = None
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        issues |= {beyond: len(data) < 12, "unsupported_container": len(data) >= 12 and data[:4] != b"RIFF", "unsupported_wave_type": len(data) >= 12 and data[:4] == b"RIFF"}
    else:
        found = layout(data)
        extent = found.extent
        issues |= {"invalid_riff_extent": extent < 12}
        if extent >= 12:
            seen = _reach(found)
            unread = len(seen) < len(found.chunks) or bool(seen) and seen[-1].name == b"fmt " and len(seen[-1].body) < min(seen[-1].size, 18 if seen[-1].size == 18 else 16) and seen[-1].size >= 16
            formats, bodies = ([c for c in seen if c.name == name] for name in (b"fmt ", b"data"))
            fields = _fields(formats[0]) if formats and formats[0].size >= 16 else {}
            if bodies:
                fields["data_declared_bytes"] = bodies[0].size
            align = fields.get("block_align_bytes")
            judged = [c for c in bodies if formats and formats[0].at < c.at]
            last = seen[-1] if seen else None
            cut = found.stopped == "cut" and not unread and last is not None
            issues |= {
                "provider_size_mismatch": size is not None and size != extent,
                "truncated_or_trailing_container": whole and len(data) != extent,
                "trailing_bytes": len(data) > extent,
                **(_format_rules(formats[0], _fields(formats[0])) if formats else {}),
                "duplicate_fmt": len(formats) > 1,
                "duplicate_data": len(bodies) > 1,
                "data_before_fmt": len(judged) < len(bodies),
                "unaligned_data_size": bool(align) and any(c.size % align for c in judged),
                "truncated_chunk_header": found.stopped == "no room" and not unread,
                "chunk_extent_outside_riff": found.stopped == "too large" and not unread,
                "truncated_chunk_payload": cut and whole,
                "data_body_uninspected": cut and not whole and last.name == b"data",
                "trailing_chunks_uninspected": cut and not whole and last.name == b"data" and last.end < extent,
            }
            out_of_sight = unread or found.stopped == "out of sight"
            issues[beyond] = out_of_sight or issues.get(beyond, False)
            issues["header_prefix_incomplete"] = issues.get("header_prefix_incomplete", False) or cut and not whole and last.name != b"data"
            lacking = not (formats and bodies)
            ended = found.stopped is None or whole
            issues |= {"missing_required_chunk": lacking and ended, "required_header_unobserved": lacking and not ended, "audio_body_not_validated": True}
    codes = [code for code, holds in issues.items() if holds]
    worst = next((kind for kind in KINDS if any(code in WEIGHT[kind] for code in codes)), None)
    known = worst is None and "format_code" in fields and "data_declared_bytes" in fields and fields.get("byte_rate")
    seconds = fields["data_declared_bytes"] / fields["byte_rate"] if known else None
    return worst or ("observed" if known else "partial"), extent, *(fields.get(f) for f in FIELDS), seconds, codes


def wav_headers(files: DataFrame) -> DataFrame:
    """Declarations of files (path, length, content); 64 KiB of each reach Python."""
    some = files.select("path", "length", F.substring("content", 1, PREFIX + 1).alias("prefix"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "status", "riff_declared_bytes", *FIELDS, "declared_duration_sec", "issues"]
        for b in batches:
            out = pd.DataFrame([(p, *probe(bytes(x), int(n), int(n) <= PREFIX)) for p, n, x in zip(b.path, b.length, b.prefix, strict=True)], columns=names)
            yield out.astype({f: "Int64" for f in ["riff_declared_bytes", *FIELDS]})

    return some.mapInPandas(run, SCHEMA)
