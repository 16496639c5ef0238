"""Spreadsheets (xlsx): every cell as text, read in parallel by tab; tables written as workbooks by the executors.

Files are read through Spark's binary source, so any file system that Spark reads will do.
``write_workbooks`` and the data source behind it (``format("workbook")``) write one workbook a
partition or a file name, on a file system that pyarrow knows; ``workbook`` is for small ones on the driver.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rosterloom.functions.text import let

#: Fixed value: rows that a sheet can hold.
SHEET_ROWS = 1_048_576

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LINK = f"{{{_OFFICE}}}id"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def _letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_parts(content: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """(tab, sheet, shared texts) of every tab of a workbook, packed, so that each can be read elsewhere."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = zlib.compress(book.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else b"", 1)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)].lstrip("/")
            yield sheet.get("name"), zlib.compress(book.read(target if target.startswith("xl/") else f"xl/{target}"), 1), shared


def sheet_rows(sheet: bytes, texts: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of every row of a packed sheet, one row in memory at a time."""
    shared: list[str] = []
    if packed := zlib.decompress(texts):
        for item in ElementTree.fromstring(packed).iter(f"{_MAIN}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
    for _, row in ElementTree.iterparse(io.BytesIO(zlib.decompress(sheet))):
        if row.tag != f"{_MAIN}row":
            continue
        cells: list[str | None] = []
        for cell in row.iter(f"{_MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value = cell.find(f"{_MAIN}v")
            if cell.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        yield int(row.get("r", 0)) - 1, cells
        row.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, tab, row_ix and cells (array of text) of all rows of all workbooks under ``path``.

    Workbooks are taken apart first and dealt out by tab, so that the tabs of one are read side by side.
    """
    def apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                for tab, sheet, texts in sheet_parts(bytes(content)):
                    yield pd.DataFrame([(file, tab, sheet, texts)], columns=["file", "tab", "sheet", "texts"])

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, tab, sheet, texts in frame.itertuples(index=False):
                rows = []
                for row in sheet_rows(bytes(sheet), bytes(texts)):
                    rows.append((file, tab, *row))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "tab", "row_ix", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "tab", "row_ix", "cells"])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    sheets = books.mapInPandas(apart, "file string, tab string, sheet binary, texts binary").repartition("file", "tab")
    return sheets.mapInPandas(decode, "file string, tab string, row_ix long, cells array<string>")


def clean_names(cells: Column) -> Column:
    """``schema.clean_headers`` of an array of header cells, as a Column."""
    lines = F.transform(cells, lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))))
    named = F.transform(lines, lambda c: F.when(c == "", F.lit("empty_column")).otherwise(c))

    def numbered(names):
        def own(name, i):
            before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda other: other == name))
            return F.when(before > 0, F.concat(name, F.lit("."), before.cast("string"))).otherwise(name)

        return F.transform(names, own)

    return let(named, numbered)


def _is_number(cell: Column) -> Column:
    return F.coalesce(F.trim(cell).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.lit(False))


def header_rows(cells: DataFrame) -> DataFrame:
    """file, tab, and of each tab: header_ix and header (clean names), last_ix (its last filled row), width, first_data_ix.

    The header is the first row that is filled to the tab's width, if it stands above the first row with
    a number and has none itself; else it is the row before that first row of numbers. A tab whose
    first filled row has numbers has no header of its own: it is named by its places, col0, col1, ...
    """
    full = F.filter("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    rows = cells.select("file", "tab", "row_ix", "cells", F.size(full).alias("_filled"), F.exists("cells", _is_number).alias("_numbers"))
    rows = rows.filter("_filled > 0")
    tabs = rows.groupBy("file", "tab").agg(F.max("_filled").alias("width"), F.max("row_ix").alias("last_ix"), F.min("row_ix").alias("_first"), F.min(F.when(F.col("_numbers"), F.col("row_ix"))).alias("_data"), F.max(F.size("cells")).alias("_cells"))
    both = rows.join(tabs, ["file", "tab"])
    row = F.struct("row_ix", "cells")
    plain = both.groupBy("file", "tab", "width", "last_ix", "_first", "_data", "_cells").agg(
        F.min(F.when((F.col("_filled") == F.col("width")) & ~F.col("_numbers") & (F.col("_data").isNull() | (F.col("row_ix") < F.col("_data"))), row)).alias("_full"),
        F.max(F.when(F.col("row_ix") < F.col("_data"), row)).alias("_above"),
        F.min(row).alias("_any"),
    )
    head = F.coalesce("_full", "_above", F.when(F.col("_data").isNull(), F.col("_any")))
    places = F.transform(F.sequence(F.lit(0), F.col("_cells") - 1), lambda i: F.concat(F.lit("col"), i.cast("string")))
    found = plain.withColumn("_head", head)
    return found.select(
        "file", "tab", F.coalesce(F.col("_head.row_ix"), F.col("_first") - 1).alias("header_ix"), F.when(F.col("_head").isNull(), places).otherwise(clean_names(F.col("_head.cells"))).alias("header"),
        "last_ix", "width", F.coalesce("_data", F.col("_head.row_ix") + 1).alias("first_data_ix"),
    )


#: Fixed value: columns that a sheet can have.
SHEET_COLUMNS = 16_384


def tab_frame(cells: DataFrame, tab: str, with_file: bool = False) -> DataFrame:
    """One tab of all files as a table of text columns, each file under its own header (``header_rows``).

    Rows above a header and after the last filled row of a file go; blank rows between stay. Files
    may have other headers: a column that a file lacks is null. The columns are the names that any header
    has, by their first place and name; all files are one query. ``cells`` is read three times, so
    it should be a stored table (``store_cells``).
    """
    own = cells.filter(F.col("tab") == tab)
    heads = header_rows(own)
    places = heads.select(F.posexplode("header").alias("place", "name")).groupBy("name").agg(F.min("place").alias("place")).limit(SHEET_COLUMNS + 1).collect()
    if len(places) > SHEET_COLUMNS:
        raise ValueError(f"the files have more than {SHEET_COLUMNS} names of columns")
    names = [r.name for r in sorted(places, key=lambda r: (r.place, r.name))]
    rows = own.join(heads.drop("tab"), "file").filter("row_ix > header_ix AND row_ix <= last_ix")
    value = lambda name: F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1)
    columns = [F.when(F.array_contains("header", name), value(name)).alias(name) for name in names]
    return rows.select(*["file"] * with_file, "row_ix", *columns)


def store_cells(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``read_cells``, parsed once and written to ``folder`` by tab."""
    read_cells(spark, path).write.mode("overwrite").partitionBy("tab").parquet(folder)
    return spark.read.parquet(folder).select("file", F.col("tab").cast("string").alias("tab"), "row_ix", "cells")


class _Book:
    """A workbook that is written row by row; a full sheet is followed by another one."""

    def __init__(self, out: io.IOBase, columns: list[str], sheet_rows: int = SHEET_ROWS):
        self._book = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self._columns, self._most, self._sheets, self._sheet, self._row, self._tab = columns, sheet_rows, [], None, 0, None

    def _line(self, values) -> None:
        self._row += 1
        cells = "".join(f'<c r="{_letters(c)}{self._row}" t="inlineStr"><is><t xml:space="preserve">{escape(_text(v))}</t></is></c>' for c, v in enumerate(values) if v is not None)
        self._sheet.write(f'<row r="{self._row}">{cells}</row>'.encode())

    def _end(self) -> None:
        if self._sheet is not None:
            self._sheet.write(b"</sheetData></worksheet>")
            self._sheet.close()

    def add(self, tab: str, values) -> None:
        if tab != self._tab or self._row >= self._most:
            self.begin(tab)
        self._line(values)

    def begin(self, tab: str) -> None:
        self._end()
        self._tab, again = tab, sum(t == tab for t, _ in self._sheets)
        self._sheets.append((tab, f"{tab[:24]} ({again + 1})" if again else tab[:31]))
        self._sheet, self._row = self._book.open(f"xl/worksheets/sheet{len(self._sheets)}.xml", "w", force_zip64=True), 0
        self._sheet.write(f'<?xml version="1.0"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
        self._line(self._columns)

    def close(self) -> None:
        self._end()
        sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (_, name) in enumerate(self._sheets, 1))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self._sheets) + 1))
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(self._sheets) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        self._book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
        self._book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{links}</Relationships>')
        self._book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self._book.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        )
        self._book.close()


def _text(value) -> str:
    """A cell's text, without the control characters that XML can't hold."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))


def workbook(frames: dict[str, DataFrame]) -> bytes:
    """A workbook of small tables, a sheet for each; a table beyond a sheet's rows is refused. ``write_workbooks`` has no such bound."""
    out = io.BytesIO()
    book = _Book(out, [])
    for name, frame in frames.items():
        rows = frame.limit(SHEET_ROWS).collect()
        if len(rows) == SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds; use write_workbooks")
        book._columns = frame.columns
        book.begin(name)
        for row in rows:
            book.add(name, row)
    book.close()
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    """The finished files of a task, under the folder of what isn't committed yet."""

    files: list[str]


class WorkbookWriter(DataSourceWriter):
    """Writes its partition's rows in order: a workbook for each ``fileColumn`` value, or one for the partition; a sheet for each ``tabColumn`` value.

    A task writes under a folder of its own; the driver moves finished files when all tasks have
    ended, so that a task that is lost and run again leaves nothing.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.file, self.tab, self.rows = options.get("filecolumn"), options.get("tabcolumn"), int(options.get("sheetrows", SHEET_ROWS))
        self.columns = [c for c in schema.names if c not in (self.file, self.tab)]

    def _folder(self):
        system, base = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        return system, base.rstrip("/")

    def write(self, iterator) -> Written:
        system, base = self._folder()
        held = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(held, recursive=True)
        names, book, out, current = [], None, None, None
        for row in iterator:
            name = str(row[self.file]) if self.file else f"part-{TaskContext.get().partitionId():05d}"
            if book is None or name != current:
                if book is not None:
                    book.close()
                    out.close()
                current = name
                names.append(f"{re.sub(r'[^A-Za-z0-9._-]+', '_', name)}.xlsx" if self.file else f"{name}.xlsx")
                out = system.open_output_stream(f"{held}/{names[-1]}")
                book = _Book(out, self.columns, self.rows)
            book.add(str(row[self.tab]) if self.tab else "Sheet1", [row[c] for c in self.columns])
        if book is not None:
            book.close()
            out.close()
        return Written([f"{held}/{name}" for name in names])

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._folder()
        for file in (f for m in messages if m for f in m.files):
            system.move(file, f"{base}/{file.rsplit('/', 1)[1]}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, system, base: str) -> None:
        held = f"{base}/_temporary-{self.job}"
        if system.get_file_info(held).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(held)


class WorkbookSource(DataSource):
    """``frame.write.format("workbook").option("path", folder)``, with the options fileColumn, tabColumn and sheetRows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options))


def write_workbooks(frame: DataFrame, folder: str, file: str | None = None, tab: str | None = None, order: list[str] | None = None, sheet_rows: int = SHEET_ROWS) -> None:
    """``frame`` as workbooks in ``folder``, by the executors; no row passes the driver.

    With ``file`` there is a workbook for each of its values, else one for each partition; ``tab``
    names the sheet of a row. Rows are written by ``order``; a sheet that is full is followed by another.
    """
    frame.sparkSession.dataSource.register(WorkbookSource)
    keys = [c for c in (file, tab) if c]
    if file:
        frame = frame.repartition(file)
    if keys or order:
        frame = frame.sortWithinPartitions(*keys, *(order or []))
    writer = frame.write.format("workbook").mode("append").option("path", folder).option("sheetRows", sheet_rows)
    for name, value in (("fileColumn", file), ("tabColumn", tab)):
        writer = writer.option(name, value) if value else writer
    writer.save()
