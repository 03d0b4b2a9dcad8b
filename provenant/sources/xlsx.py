"""Stored cells of XLSX workbooks; formulas are text, nothing is worked out."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CELLS = "file string, sheet string, ref string, row int, column int, type string, value string, formula string, issue string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOST_BYTES = 256 << 20


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    data = book.read(name)
    if b"<!DOCTYPE" in data:  # anywhere: comments may stand before it
        raise ValueError("document_type_declaration")
    return data


def _workbook(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        if len(names) != len(set(names)):
            raise ValueError("duplicate_zip_member")
        if sum(i.file_size for i in book.infolist()) > MOST_BYTES:
            raise ValueError("expansion_limit")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(_part(book, "xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(_part(book, "xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(_part(book, "xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            place = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for row_no, row in enumerate(ET.fromstring(_part(book, place)).iter(f"{_MAIN}row"), 1):
                for c in row.iter(f"{_MAIN}c"):
                    kind, ref = c.get("t", "n"), c.get("r") or ""
                    raw, formula = c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f")
                    value = shared[int(raw)] if kind == "s" and raw is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else raw
                    letters = re.sub(r"\d", "", ref)
                    column = 0
                    for x in letters:
                        column = column * 26 + ord(x) - 64
                    yield sheet.get("name"), ref, int(re.sub(r"\D", "", ref) or row_no), column, kind, value, formula, None


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "sheet", "ref", "row", "column", "type", "value", "formula", "issue"]
    for b in batches:
        for path, content in zip(b.path, b.content, strict=True):
            out = []
            try:
                for cell in _workbook(content):
                    out.append((path, *cell))
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, IndexError) as bad:
                out.append((path, *[None] * 7, f"unreadable_workbook: {bad}"))
            if out:
                yield pd.DataFrame(out, columns=names)


def xlsx_cells(files: DataFrame) -> DataFrame:
    """A row for each stored cell of files (path, content); an unreadable workbook gives one row with an issue."""
    return files.select("path", "content").mapInPandas(_cells, CELLS)
