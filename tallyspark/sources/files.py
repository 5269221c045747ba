"""Delimited text files to raw tables: every cell is text, and source_row keeps the file's order.

Delimiter and header are decided from the first lines, the encoding from the whole file, chunk by chunk. Records
are read in byte ranges by many tasks (``records``) and written once.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as X

from .records import chunks, read_records, whole_chunks
from .shared import new_folder

# Fixed limits.
MOST_MB, SNIFF_BYTES, SNIFF_LINES, HEADER_ROWS, HEADER_FILL = 50, 1 << 16, 50, 30, 0.60
DELIMITERS = [",", ";", "\t"]


class LoadError(ValueError):
    """A file that can't be read, with a reason for its owner."""


@dataclass
class LoadReport:
    encoding: str = ""
    delimiter: str = ""
    header_row: int = 0
    sha256: str = ""
    warnings: list[str] = field(default_factory=list)


def encoding_of(data: bytes, cut: bool = False) -> str:
    """By byte order mark, else UTF-8 if it decodes, else Latin-1; zero bytes mean that it is no text. cut: the data go on."""
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    if b"\0" in data:
        raise LoadError("the file holds binary data")
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(data, final=not cut)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def delimiter_of(text: str) -> str:
    """The delimiter whose rows agree most on their width, then the widest."""
    lines = [line for line in text.splitlines() if line.strip()][:SNIFF_LINES]

    def rank(d: str) -> tuple[float, int]:
        widths = [len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d)]
        usual = max(set(widths), key=widths.count) if widths else 1
        return (widths.count(usual) / len(widths) if usual > 1 else 0.0, usual)

    return max(DELIMITERS, key=rank)


def header_row(rows: list[list[str]]) -> int:
    """The first of 30 rows with at least 60 % as many filled cells as the widest."""
    filled = [sum(bool(c.strip()) for c in r) for r in rows[:HEADER_ROWS]]
    widest = max(filled, default=0)
    if not widest:
        raise LoadError("the file is empty")
    return next(i for i, n in enumerate(filled) if n >= HEADER_FILL * widest)


def unique_headers(names: list[str]) -> list[str]:
    """Repeated names get a number, empty ones a place."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        name = " ".join(name.replace("`", "'").split()) or f"Unnamed column {i}"
        new, n = name, 1
        while new in out:
            n += 1
            new = f"{name} ({n})"
        out.append(new)
    return out


def content(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file; the bytes stay on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _sniffed(packed: DataFrame) -> tuple[bytes, bool]:
    """The first bytes of a file, and whether all of it is UTF-8."""
    head = packed.select("block", "part", F.substring("data", 1, SNIFF_BYTES).alias("head")).orderBy("block", "part").first()
    good = packed.agg(F.min(F.is_valid_utf8(F.col("data").cast("string"))).alias("utf8")).first()
    return (bytes(head["head"]) if head else b""), good["utf8"] is not False


def load_file(spark: SparkSession, path: str, max_mb: int | None = MOST_MB, in_parts: bool = False) -> tuple[DataFrame, LoadReport]:
    """(raw table, report). Blank rows and columns go, short rows are padded with NULL. max_mb: None reads files of any size.
    in_parts: the path has several files that are parts of one, in the order of their names.

    The report's digest is SHA-256 of the bytes up to the size limit; of larger files it is put together from
    hashes of their numbered records.
    """
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("xls", "xlsx"):
        raise LoadError("read workbooks with spark.read.format('workbooks')" if ending == "xlsx" else "save the old workbook as .xlsx or CSV")
    if ending not in ("csv", "tsv", "txt"):
        raise LoadError(f"unknown file type .{ending}")
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("files")).first()
    if not size["length"]:
        raise LoadError("the file is empty")
    small = size["files"] == 1 and size["length"] <= MOST_MB << 20
    if size["files"] > 1 and not in_parts:
        raise LoadError("several files; read them one by one or as parts of one")
    if max_mb is not None and size["length"] > max_mb << 20:
        raise LoadError(f"the file is larger than {max_mb} MB")
    packed = chunks(spark, path, in_parts)
    head, utf8 = _sniffed(packed)
    report = LoadReport(encoding=encoding_of(head, cut=True))
    if report.encoding == "utf-8" and not utf8:
        report.encoding = "latin-1"
    if report.encoding == "utf-16":
        packed = whole_chunks(spark, path, "utf-16", in_parts)
        head = _sniffed(packed)[0]
    within = {"utf-16": "utf-8", "utf-8-sig": "utf-8"}.get(report.encoding, report.encoding)
    sample = codecs.getincrementaldecoder(within)("replace").decode(head).removeprefix("\ufeff")
    report.delimiter = delimiter_of(sample)
    rows = [(i, r) for i, r in enumerate(csv.reader(io.StringIO(sample, newline=""), delimiter=report.delimiter)) if r]
    report.header_row, header = rows[header_row([r for _, r in rows])]
    folder = new_folder(spark, "upload")
    found = read_records(packed, report.delimiter, within).where(F.col("record") > report.header_row).select(F.col("record").alias("source_row"), F.transform("cells", lambda c: F.nullif(c, F.lit(""))).alias("cells"))
    found.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).write.parquet(f"{folder}/records")
    body = spark.read.parquet(f"{folder}/records")
    beyond = F.exists(F.slice("cells", len(header) + 1, F.greatest(F.size("cells") - len(header), F.lit(0))), lambda c: F.trim(c) != "")
    facts = body.agg(F.max(F.size("cells")).alias("width"), F.coalesce(F.count_if(beyond), F.lit(0)).alias("ragged"), F.coalesce(F.bit_xor(F.xxhash64("source_row", "cells")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("source_row", "cells").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    report.sha256 = content(spark, path).first()["sha256"] if small else hashlib.sha256(f"{size['length']} {facts['x']} {facts['s']} {header}".encode()).hexdigest()
    width = max(len(header), facts["width"] or 0)
    if facts["ragged"]:
        report.warnings.append(f"{facts['ragged']} rows are wider than the header; the extra values are in unnamed columns")
    names = unique_headers(header + [""] * (width - len(header)))
    cells = [F.get("cells", F.lit(i)) for i in range(width)]
    empty = [i for i in range(width) if names[i].startswith("Unnamed column")]
    if empty:
        used = body.agg(*(F.max(F.trim(F.coalesce(cells[i], F.lit(""))) != "").alias(f"c{i}") for i in empty)).first()
        empty = [i for i in empty if not used[f"c{i}"]]
        report.warnings += [f"column {i + 1} is empty" for i in empty]
    return body.select("source_row", *(cells[i].alias(names[i]) for i in range(width) if i not in empty)), report


def knowledge(spark: SparkSession) -> DataFrame:
    """field, words: the header dictionary as a table (a few hundred rows)."""
    from tallyspark.operators.mapping import SYNONYMS

    return spark.createDataFrame([(f, s) for f, names in SYNONYMS.items() for s in names], "field string, words string").withColumn("key", X.header_key(F.col("words")))
