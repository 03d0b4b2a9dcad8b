"""Delimited text: encodings, delimiters, and every cell with its record."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
CELLS = "file string, row int, column int, value string, raw_record string, start_line int, encoding string, delimiter string, complete boolean, issue string"


def infer_delimiter(lines: DataFrame, key: str = "file", line: str = "line", delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """`key`, delimiter, status: a delimiter qualifies if all lines have one width above 1; one alone is accepted, else a comma is provisional."""
    each = lines.select(key, F.explode(F.array(*(F.struct(F.lit(d).alias("delimiter"), F.size(F.split(line, d if d not in "|" else r"\|")).alias("width")) for d in delimiters))).alias("x")).select(key, "x.*")
    fits = each.groupBy(key, "delimiter").agg(F.min("width").alias("low"), F.max("width").alias("high"))
    chosen = fits.groupBy(key).agg(F.count_if((F.col("low") == F.col("high")) & (F.col("low") > 1)).alias("n"), F.max(F.when((F.col("low") == F.col("high")) & (F.col("low") > 1), F.col("delimiter"))).alias("d"))
    return chosen.select(key, F.when(F.col("n") == 1, F.col("d")).otherwise(",").alias("delimiter"), F.when(F.col("n") == 1, "accepted").otherwise("ambiguous").alias("status"))


def _decode(content: bytes) -> tuple[str, str]:
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace"), "utf-16"
    try:
        return content.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("cp1250", "replace"), "cp1250"


#: Characters that the delimiter is guessed from.
SNIFFED = 8192


def _lines(text: str) -> list[str]:
    """Physical lines with their ends (CR, LF, CRLF); line and page separators within a cell are text."""
    return list(io.StringIO(text, newline=""))


def _delimiter(text: str, lines: list[str], name: str) -> tuple[str, int]:
    """The delimiter and how many lines announce it: a `sep=` line, the ending .tsv, what a sniff of the start finds, else the commonest in the first line."""
    first = lines[0] if lines else ""
    announced = first.rstrip("\r\n")
    if announced.lower().startswith("sep=") and len(announced) == 5:
        return announced[4], 1
    if name.lower().endswith(".tsv"):
        return "\t", 0
    try:
        return csv.Sniffer().sniff(text[:SNIFFED], "".join(DELIMITERS)).delimiter, 0
    except csv.Error:
        return max(DELIMITERS, key=first.count) if any(map(first.count, DELIMITERS)) else ",", 0


#: Cells of an Arrow batch that the reader gives, about: of one file or of many small ones.
BATCH_CELLS = 10_000
Record = tuple[int, int, str, int, int, bool, str | None]


def _cell_rows(files: list[tuple[str, str, str]], records: list[Record], values: list[str | None]) -> pa.RecordBatch:
    """CELLS of records (place in `files`, row, raw text, start line, width, complete, issue) with their values one after another. One that isn't complete is the rest of a file that can't be read."""
    of_file, row, raw, start, width, complete, issue = zip(*records, strict=True)
    width = np.array(width)
    record = np.repeat(np.arange(len(records)), width)
    column = np.arange(len(values)) - np.repeat(np.cumsum(width) - width, width)
    complete = np.array(complete)[record]
    each, first = pa.array(record), pa.array(record, mask=column > 0)
    file = pa.array(np.array(of_file)[record])
    paths, encodings, delimiters = (pa.array(c, pa.string()).take(file) for c in zip(*files, strict=True))
    return pa.RecordBatch.from_arrays([
        paths, pa.array(row, pa.int32()).take(each), pa.array(column, pa.int32(), mask=~complete), pa.array(values, pa.string()), pa.array(raw, pa.string()).take(first), pa.array(start, pa.int32()).take(each),
        encodings, delimiters, pa.array(complete), pa.array(issue, pa.string()).take(first),
    ], names=["file", "row", "column", "value", "raw_record", "start_line", "encoding", "delimiter", "complete", "issue"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: list[tuple[str, str, str]] = []
    records: list[Record] = []
    values: list[str | None] = []
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            path = path.as_py()
            text, encoding = _decode(content.as_py())
            lines = _lines(text)
            delimiter, skip = _delimiter(text, lines, path)
            reader = csv.reader(lines[skip:], delimiter=delimiter, strict=True)
            issue = "encoding_fallback_cp1250" if encoding == "cp1250" else None
            files.append((path, encoding, delimiter))
            row, at = 0, skip
            try:
                for cells in reader:
                    end = skip + reader.line_num
                    if cells:
                        records.append((len(files) - 1, row, lines[at] if end == at + 1 else "".join(lines[at:end]), at + 1, len(cells), True, None if row else issue))
                        values += cells
                    row, at = row + 1, end
                    if len(values) >= BATCH_CELLS:
                        yield _cell_rows(files, records, values)
                        files, records, values = files[-1:], [], []
            except csv.Error as bad:
                records.append((len(files) - 1, row, "".join(lines[at:]), at + 1, 1, False, f"malformed_record: {bad}"))
                values.append(None)
    if records:
        yield _cell_rows(files, records, values)


def delimited_cells(files: DataFrame) -> DataFrame:
    """A row for each cell of files (path, content); a record's text stands with its first cell; what can't be read is an issue with
    the whole rest of the file, complete being false."""
    return files.select("path", "content").mapInArrow(_cells, CELLS)


def typed_observations(cells: DataFrame) -> DataFrame:
    """Cells of data rows with the kind their header names: phones, times, durations, file references, contacts, each with its candidate."""
    from provenant.functions.scalars import duration_view, header_kind, iso_ts, phone_candidate

    header = cells.filter("row = 0").select("file", "column", F.col("value").alias("header"))
    found = header_kind(cells.filter("row > 0").join(header, ["file", "column"]), "header").filter("header_kind is not null")
    d, t = duration_view(F.col("value"), F.col("header")), iso_ts(F.col("value"))
    return found.select("file", "row", "column", "header", F.col("header_kind").alias("kind"), F.col("value").alias("raw_value"), F.when(F.col("header_kind") == "phone", phone_candidate(F.col("value"))).when(F.col("header_kind") == "timestamp", t["local"].cast("string")).when(F.col("header_kind") == "duration", d["seconds"].cast("string")).alias("candidate"))


def records(cells: DataFrame) -> DataFrame:
    """Rows as arrays of cells in order of column."""
    return cells.groupBy("file", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda x: x["value"]).alias("values"))


def first_lines(lines: DataFrame, n: int, key: str = "file", order: str = "i") -> DataFrame:
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


__all__ = ["delimited_cells", "first_lines", "infer_delimiter", "records", "typed_observations"]
