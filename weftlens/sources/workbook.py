"""Workbooks (xlsx) as a data source, read with the standard library: ``spark.read.format("workbook").load(path)``.

One row per cell row: ``file, sheet, row, cells`` (a list of texts), numbers as their text. Options: ``skip`` (a pattern
of sheet names to leave out, e.g. summaries). A sheet is one partition. ``write_workbook`` is the matching exporter.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "file string, sheet string, row int, cells array<string>"


def sheets_of(path: str) -> list[tuple[str, str]]:
    """``(name, part)`` of each sheet of a workbook, in order."""
    with zipfile.ZipFile(path) as book:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            found.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
        return found


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def rows_of(path: str, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """``(row, cells)`` of one sheet; empty rows are left out."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with book.open(part) as raw:
            for _, row in ElementTree.iterparse(raw):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else place
                    cells += [None] * (at - len(cells))
                    kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    cells.append(value)
                if any(c not in (None, "") for c in cells):
                    yield int(row.get("r") or 0), cells
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str, skip: str | None) -> None:
        self.path, self.skip = path, skip

    def partitions(self) -> Sequence[InputPartition]:
        plain = self.path.removeprefix("file:")
        files = sorted(glob.glob(os.path.join(plain, "**", "*.xlsx"), recursive=True)) if os.path.isdir(plain) else sorted(glob.glob(plain))
        found = [(f, s, p) for f in files if not os.path.basename(f).startswith("~$") for s, p in sheets_of(f) if not (self.skip and re.search(self.skip, s, re.I))]
        return [InputPartition(x) for x in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, sheet, part = partition.value
        for row, cells in rows_of(file, part):
            yield file, sheet, row, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("skip"))


def read_workbooks(spark: SparkSession, path: str, skip: str | None = r"summary|readme") -> DataFrame:
    from weftlens.runtime import ship_package

    ship_package(spark)
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    return (reader.option("skip", skip) if skip else reader).load(path)


def with_header(rows: DataFrame, header_row: int = 1, names: Sequence[str] | None = None) -> DataFrame:
    """Named columns from rows of cells: by the given names, or by the header row of the first sheet; short rows are padded."""
    if names is None:
        head = rows.filter(F.col("row") == header_row).orderBy("file", "sheet").select("cells").first()
        names = unique_headers(head[0] if head else [])
    body = rows.filter(F.col("row") > header_row)
    return body.select("file", "sheet", "row", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def unique_headers(cells: Sequence[str | None]) -> list[str]:
    """Headers made unique: ``name``, ``name (2)``; empty ones by their place."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def find_header_row(cells: Sequence[Sequence[str | None]], wanted: Sequence[str], within: int = 10) -> int | None:
    """The index of the row, among the first ten, that holds most of the wanted headers; None if none holds any."""
    key = lambda c: re.sub(r"[^a-z0-9]+", " ", (c or "").lower()).strip()
    want = {key(w) for w in wanted}
    scores = [(len(want & {key(c) for c in row}), -i) for i, row in enumerate(cells[:within])]
    best = max(scores, default=(0, 0))
    return -best[1] if best[0] else None


def sheet_name(name: str, taken: set[str] | None = None) -> str:
    """A name a workbook accepts: at most 31 characters, none of ``[]:*?/\\``, unique."""
    base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    out, n = base, 2
    while taken is not None and out.lower() in taken:
        out = f"{base[: 31 - len(f' ({n})')]} ({n})"
        n += 1
    if taken is not None:
        taken.add(out.lower())
    return out


def write_workbook(path: str, sheets: dict[str, DataFrame], most_rows: int = 1_000_000) -> None:
    """A workbook of small result tables, written on the driver; a table of more rows than a sheet can hold is refused."""
    taken: set[str] = set()
    named = [(sheet_name(n, taken), df) for n, df in sheets.items()]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(named) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(named, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (name, df) in enumerate(named, 1):
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name}: more than {most_rows} rows")
            cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[^\t\n\r\x20-\U0010ffff]", "", str(v)))}</t></is></c>'
            body = "".join(f'<row r="{k}">{"".join(map(cell, r))}</row>' for k, r in enumerate([df.columns, *rows], 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
