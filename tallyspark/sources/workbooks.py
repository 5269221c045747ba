"""Workbooks (.xlsx) as a Spark data source: spark.read.format("workbooks").load(folder).

One partition is one sheet of one file. A partition opens its file itself, streams the sheet's XML through a
pull parser and yields rows as they come, so memory holds one row and the shared texts of the workbook.
Files are opened through pyarrow's file systems (local folders, HDFS and object stores that it knows by their
addresses).

Rows: file, sheet, sheet_no (from 0, in the order of the workbook), row (from 1), cells: array of text.
Rows without cells don't come. Dates are ISO text, whole numbers have no decimals, truth values
are TRUE and FALSE; formulas give their stored results. Options: ``sheets`` (names, comma-separated) leaves the
other sheets unread. Spark's hand-over of filters isn't used: it keeps the first query's partitions for later queries
over the same table.

Files that are no workbooks give a row without a sheet whose ``error`` says why.

write_workbooks streams a table into workbooks, one for each value of a column.
"""

from __future__ import annotations

import datetime as dt
import numbers
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, sheet_no int, row long, cells array<string>, error string"
# How an encrypted or old workbook begins, what an encrypted one holds, number formats that are dates.
OLD, SEALED = bytes.fromhex("d0cf11e0a1b11ae1"), "EncryptedPackage".encode("utf-16-le")
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Names of sheets that describe columns have one of these words; so much of their text is kept.
DICTIONARY_WORDS = ["dictionary", "definition", "glossary", "readme", "read me", "metadata", "field guide", "column guide", "notes"]
MOST_CHARS = 4_000
#: Rows that a sheet can have.
MOST_ROWS = 1 << 20
#: Characters that XML can't hold.
_UNWRITABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _named(element, name: str) -> str | None:
    """An attribute by its name without a namespace."""
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = path.rstrip("/")
    return [f"{base}/{f.path[len(inner.rstrip('/')) + 1 :]}" for f in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.lower().endswith((".xlsx", ".xlsm"))]


class Workbook:
    """The parts of an opened workbook."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        if "xl/workbook.xml" not in names:
            raise zipfile.BadZipFile("no workbook")
        with self.zip.open("xl/workbook.xml") as part:
            book = ElementTree.parse(part).getroot()
        with self.zip.open("xl/_rels/workbook.xml.rels") as part:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(part).getroot()}
        self.day_0 = dt.datetime(1899, 12, 30)
        self.sheets: list[tuple[str, str]] = []
        for element in book.iter():
            if _local(element.tag) == "workbookPr" and element.get("date1904") in ("1", "true"):
                self.day_0 = dt.datetime(1904, 1, 1)
            elif _local(element.tag) == "sheet":
                part = posixpath.normpath(posixpath.join("/xl", targets[_named(element, "id")])).lstrip("/")
                if part in names and "worksheets" in part:
                    self.sheets.append((element.get("name"), part))

    def _stream(self, part: str) -> Iterator[tuple[str, ElementTree.Element]]:
        """Elements as they end."""
        with self.zip.open(part) as source:
            for _, element in ElementTree.iterparse(source):
                yield _local(element.tag), element

    def texts(self) -> list[str]:
        """The shared texts, without phonetic hints."""
        out, runs, hint = [], [], 0
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return out
        with self.zip.open("xl/sharedStrings.xml") as source:
            for event, element in ElementTree.iterparse(source, events=("start", "end")):
                kind = _local(element.tag)
                if kind == "rPh":
                    hint += 1 if event == "start" else -1
                elif event == "end" and kind == "t" and not hint:
                    runs.append(element.text or "")
                elif event == "end" and kind == "si":
                    out.append("".join(runs))
                    runs = []
                    element.clear()
        return out

    def dated(self) -> list[bool]:
        """For each cell style, whether its numbers are dates."""
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        with self.zip.open("xl/styles.xml") as part:
            root = ElementTree.parse(part).getroot()
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _local(f.tag) == "numFmt"}
        is_date = lambda i: i in DATE_FORMATS or (i in own and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[i]).lower()) is not None)
        formats = next((e for e in root if _local(e.tag) == "cellXfs"), [])
        return [is_date(int(x.get("numFmtId", 0))) for x in formats]

    def _text(self, cell, texts: list[str], dated: list[bool]) -> str:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
        value = next((e.text or "" for e in cell if _local(e.tag) == "v"), "")
        if value == "" or kind in ("str", "e"):
            return value
        if kind == "s":
            return texts[int(value)]
        if kind == "b":
            return "TRUE" if value == "1" else "FALSE"
        if kind == "d":
            return value.replace("T00:00:00", "").replace("T", " ")
        number, style = float(value), int(cell.get("s", 0))
        if style < len(dated) and dated[style]:
            at = self.day_0 + dt.timedelta(seconds=round(number * 86_400))
            return at.strftime("%Y-%m-%d" if at.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number.is_integer() else repr(number)

    def rows(self, part: str) -> Iterator[tuple[int, list[str]]]:
        texts, dated, number = self.texts(), self.dated(), 0
        for kind, element in self._stream(part):
            if kind == "row":
                number = int(element.get("r", number + 1))
                cells: list[str] = []
                for cell in (c for c in element if _local(c.tag) == "c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [""] * (place - len(cells))
                    cells.append(self._text(cell, texts, dated))
                if cells:
                    yield number, cells
            if kind in ("row", "sheetData"):
                element.clear()


def _column(reference: str) -> int:
    """The place of a column from a cell's address: A is 0."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class _Sheet(InputPartition):
    def __init__(self, file: str, sheet: str | None, number: int | None, part: str | None, error: str | None = None):
        self.file, self.sheet, self.number, self.part, self.error = file, sheet, number, part, error


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheets: set[str] | None):
        self.path, self.sheets = path, sheets

    def partitions(self) -> list[_Sheet]:
        out = []
        for file in _files(self.path):
            try:
                with _opened(file) as source:
                    if source.read(len(OLD)) == OLD:
                        sealed = SEALED in source.read()
                        out.append(_Sheet(file, None, None, None, "the workbook has a password" if sealed else "an old workbook; save it as .xlsx"))
                        continue
                    source.seek(0)
                    sheets = Workbook(source).sheets
                out += [_Sheet(file, name, i, part) for i, (name, part) in enumerate(sheets) if self.sheets is None or name in self.sheets]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError):
                out.append(_Sheet(file, None, None, None, "damaged, or no workbook"))
        return out or [_Sheet("", None, None, None)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        if partition.error is not None:
            yield partition.file, None, None, None, None, partition.error
        elif partition.part is not None:
            with _opened(partition.file) as source:
                for number, cells in Workbook(source).rows(partition.part):
                    yield partition.file, partition.sheet, partition.number, number, cells, None


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        names = self.options.get("sheets")
        return WorkbookReader(self.options["path"], {n.strip() for n in names.split(",")} if names else None)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WorkbookSource)


_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


class _Writer:
    """One workbook that is written row by row; the first of its sheets is the table's, notes follow."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.system, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.path = f"{inner.rstrip('/')}/{name}.xlsx"
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"  # a task that runs again leaves no half file
        self.stream = self.system.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.sheet, self.rows = None, 0

    def open(self, name: str) -> None:
        self._end()
        self.names.append(name)
        self.sheet, self.rows = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        self.sheet.write(_SHEET.encode())

    def row(self, values) -> None:
        self.rows += 1
        if self.rows > MOST_ROWS:
            raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
        cells = []
        for v in values:
            if v is None or v != v:
                cells.append("<c/>")
            elif isinstance(v, bool):
                cells.append(f'<c t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, numbers.Real):
                cells.append(f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f"<c><v>{float(v)!r}</v></c>")
            else:
                text = _UNWRITABLE.sub("", str(v))
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        self.sheet.write(f'<row r="{self.rows}">{"".join(cells)}</row>'.encode())

    def _end(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> str:
        self._end()
        relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        count = range(1, len(self.names) + 1)
        self.zip.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{relations}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count) + "</Relationships>")
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relations}"><sheets>' + "".join(f"<sheet name={quoteattr(n)} sheetId=\"{i}\" r:id=\"rId{i}\"/>" for i, n in zip(count, self.names, strict=True)) + "</sheets></workbook>")
        self.zip.close()
        self.stream.close()
        self.system.move(self.part, self.path)
        return self.path


def write_workbooks(df: DataFrame, by: str, folder: str, sheet: str = "Data", notes: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """One workbook for each value of a column, streamed row by row; returns file, rows. notes: further sheets of each.

    Rows come sorted by the column, so a task holds one row and one open file. The result must be used once: reading it writes.
    """
    columns, kinds = [c for c in df.columns if c != by], dict(df.dtypes)
    plain = df.select(F.col(by).cast("string").alias("_by"), *(F.col(c) if kinds[c] in ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean") else F.col(c).cast("string") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, key, done = None, None, []

        def finished() -> tuple[str, int]:
            rows = writer.rows - 1
            for name, lines in (notes or {}).items():
                writer.open(name)
                for line in lines:
                    writer.row(line)
            return writer.close(), rows

        for batch in batches:
            for name, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or name != key:
                    if writer is not None:
                        done.append(finished())
                    writer, key = _Writer(folder, re.sub(r"[^\w .-]", "_", name) if name is not None else "none"), name
                    writer.open(sheet)
                    writer.row(columns)
                writer.row(values)
        if writer is not None:
            done.append(finished())
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "rows"])

    return plain.repartition("_by").sortWithinPartitions("_by").mapInArrow(run, "file string, rows long")


def fullest_sheet(rows: DataFrame) -> DataFrame:
    """file, sheet, filled, others: of each workbook the sheet with the most filled cells, the first of equals."""
    filled = rows.where("sheet is not null").groupBy("file", "sheet", "sheet_no").agg(F.sum(F.size(F.filter("cells", lambda c: F.trim(c) != ""))).cast("long").alias("filled"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("filled"), "sheet_no"))  # a few sheets
    return filled.withColumn("place", place).groupBy("file").agg(
        F.max(F.when(F.col("place") == 1, F.col("sheet"))).alias("sheet"), F.max("filled").alias("filled"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("sheet_no", "sheet")))), lambda s: s["sheet"]).alias("others"),
    ).where("filled > 0")


def dictionary_texts(rows: DataFrame, chosen: DataFrame, words: list[str] = DICTIONARY_WORDS, most: int = MOST_CHARS) -> DataFrame:
    """file, text: what the first other sheet whose name says that it describes columns tells, cut at a number of characters."""
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("sheet").contains(w))
    others = rows.where(named).join(chosen.select("file", F.col("sheet").alias("_chosen")), "file").where("sheet != _chosen")
    first = others.groupBy("file").agg(F.min("sheet_no").alias("sheet_no"))
    cells = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    lines = others.join(first, ["file", "sheet_no"]).select("file", "row", F.array_join(cells, " | ").alias("line")).where("line != ''")
    # only lines that can stand within the limit are gathered
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("file").orderBy("row")) - F.length("line") - 1
    kept = lines.withColumn("before", before).where(F.col("before") < most)
    return kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l")).select("file", F.substring(F.array_join("l.line", "\n"), 1, most).alias("text"))
