"""A Spark data source for spreadsheet workbooks (.xlsx), one partition a sheet, and a plain writer.

A sheet's XML is streamed from the zip row by row; a task holds the workbook's
shared strings and one batch of rows.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 4096
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = frozenset({*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)})


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _inside(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of one name, each dropped after use."""
    if name not in book.namelist():
        return
    with book.open(name) as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == wanted:
                yield e
                e.clear()


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, file in the zip) of the sheets, in their order."""
    with zipfile.ZipFile(path) as book:
        targets = {e.get("Id"): e.get("Target") for e in _inside(book, "xl/_rels/workbook.xml.rels", "Relationship")}
        out = []
        for e in _inside(book, "xl/workbook.xml", "sheet"):
            target = targets[next(v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id")]
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    own = {}
    for e in _inside(book, "xl/styles.xml", "numFmt"):
        plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
        own[int(e.get("numFmtId"))] = bool(re.search("[ymdhs]", plain, re.IGNORECASE))
    out = set()
    for styles in _inside(book, "xl/styles.xml", "cellXfs"):
        for i, e in enumerate(styles):
            number = int(e.get("numFmtId", "0"))
            if own.get(number, number in DATE_FORMATS):
                out.add(i)
    return out


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(e: ElementTree.Element) -> str:
    """The text of a string with its runs, without phonetic hints."""
    return "".join(t.text or "" for part in e if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t")


def read_sheet(path: str, file: str) -> Iterator[tuple[int, list[str | None]]]:
    """(number from 1, cells) of the rows that are there; dates as ``yyyy-MM-dd HH:mm:ss``, whole numbers without a point."""
    with zipfile.ZipFile(path) as book:
        strings = [_text(e) for e in _inside(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        from_1904 = any(e.get("date1904") in ("1", "true") for e in _inside(book, "xl/workbook.xml", "workbookPr"))
        zero = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
        number = 0
        for row in _inside(book, file, "row"):
            number, cells = int(row.get("r", number + 1)), []
            for c in row:
                if _tag(c) != "c":
                    continue
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind = c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = "".join(_text(e) for e in c if _tag(e) == "is")
                    continue
                value = next((e.text for e in c if _tag(e) == "v"), None)
                if value is None or value == "":
                    continue
                if kind == "s":
                    cells[at] = strings[int(value)]
                elif kind == "b":
                    cells[at] = "True" if value == "1" else "False"
                elif kind == "n":
                    x = float(value)
                    if int(c.get("s", "0")) in dates:
                        cells[at] = f"{zero + timedelta(milliseconds=round(x * 86_400_000)):%Y-%m-%d %H:%M:%S}"
                    else:
                        cells[at] = str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
                elif kind != "e":  # an error is no value
                    cells[at] = value
            yield number, cells


class _Sheet(InputPartition):
    def __init__(self, name: str, file: str) -> None:
        self.name, self.file = name, file


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> list[_Sheet]:
        found = [s for s in sheets(self.path) if self.sheet is None or s[0] == self.sheet]
        if not found:
            raise ValueError(f"no sheet {self.sheet!r} in {self.path}")
        return [_Sheet(*s) for s in found]

    def read(self, part: _Sheet) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []

        def batch() -> pa.RecordBatch:
            out = [pa.array([part.name] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.list_(pa.string()))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["sheet", "line", "cells"])

        for row in read_sheet(self.path, part.file):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield batch()
        if held:
            yield batch()


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", name).load(path)``: rows (sheet, line, cells). The path must be on storage that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, line long, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows (line, cells) of a sheet, by default the first one."""
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("sheet", sheet or sheets(path)[0][0]).load(path).select("line", "cells")


#: The parts of a workbook with one sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheet(df: DataFrame, path: str) -> None:
    """Rows (line, cells) as a workbook of one sheet with text cells; one task streams them into the zip."""
    import os

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        hidden, n = f"{path}.part", 0
        with zipfile.ZipFile(hidden, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _PARTS.items():
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for batch in batches:
                    for line, cells in zip(batch.column("line").to_pylist(), batch.column("cells").to_pylist()):
                        own = "".join(f'<c r="{_letters(i)}{line}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(cells) if c is not None)
                        f.write(f'<row r="{line}">{own}</row>'.encode())
                        n += 1
                f.write(b"</sheetData></worksheet>")
        os.replace(hidden, path)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.select("line", "cells").coalesce(1).sortWithinPartitions("line").mapInArrow(write, "n long").collect()
