"""Records of delimited files whose quoted fields may hold line ends, read in many tasks.

Spark reads physical lines in byte ranges. Whether a line end closes a record depends on whether a quoted field is
open there, which depends on everything before it. But a stretch of lines only maps the state in which it
begins (outside or inside a quoted field) to the state in which it ends:

1. each task packs its lines into chunks and works out their maps, and for both states how many records begin;
2. a prefix scan over the chunks of a file (a small table) gives each chunk its state and its first record's number;
3. each chunk is cut into records. What a record has in other chunks is put together by its number; those are
   at most two fragments a chunk.

So the records and their numbers are those of one reader going through the whole file.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTSIDE, INSIDE = 0, 1
_CHUNK = {"file": pa.string(), "block": pa.string(), "part": pa.int32(), "data": pa.binary()}
_RECORD = "file string, record long, cells array<string>, piece struct<block:string,part:int>, text string"
_RECORD_ARROW = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.struct([("block", pa.string()), ("part", pa.int32())]), pa.string()]


@cache
def _closed(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """What a line looks like that ends outside quotes, if it begins outside, and if it begins inside.

    A quote opens a field only as its first character; two quotes inside stand for one; what follows the
    closing quote up to the delimiter belongs to the field.
    """
    d = re.escape(delimiter)
    rest = r'[^"]*+(?:""[^"]*+)*+"(?!")' + f"[^{d}]*+"
    field = f'(?:"{rest}|(?!")[^{d}]*+)'
    return re.compile(f"{field}(?:{d}{field})*+", re.S), re.compile(f"{rest}(?:{d}{field})*+", re.S)


def after(line: str, state: int, delimiter: str) -> int:
    """The state after a line."""
    if '"' not in line:
        return state
    return OUTSIDE if _closed(delimiter)[state].fullmatch(line) else INSIDE


def summary(lines: list[str], delimiter: str) -> list[tuple[int, int]]:
    """For both states at the beginning: the state at the end, and how many records begin."""
    out = []
    for state in (OUTSIDE, INSIDE):
        begun = 0
        for line in lines:
            begun += state == OUTSIDE
            state = after(line, state, delimiter)
        out.append((state, begun))
    return out


def records(lines: list[str], state: int, delimiter: str) -> Iterator[tuple[int, str, bool, bool]]:
    """(how many records began before it in these lines, text, begins here, ends here) of each record or part of one."""
    begun, held = 0, []
    begins = state == OUTSIDE
    for line in lines:
        held.append(line)
        state = after(line, state, delimiter)
        if state == OUTSIDE:
            yield begun, "\n".join(held), begins, True
            begun += begins
            begins, held = True, []
    if held:
        yield begun, "\n".join(held), begins, False


def _place(file: str, start: int) -> str:
    """Orders stretches by file, then by place."""
    return f"{file}:{start:020d}"


def chunks(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """file, block, part, data: the lines of files in order, a few megabytes a row; (block, part) orders a file's rows.

    in_parts: all files, ordered by name, are one that was written in parts.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for batch in batches:
            at = 0
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            while at < len(files):
                end = at
                while end < len(files) and (files[end], blocks[end]) == (files[at], blocks[at]):
                    end += 1
                part = part + 1 if last == (files[at], blocks[at]) else 0
                last = (files[at], blocks[at])
                row = ("" if in_parts else last[0], _place(*last), part, b"\n".join(batch.column(2).slice(at, end - at).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _CHUNK.values(), strict=True)], list(_CHUNK))
                at = end

    return lines.mapInArrow(pack, "file string, block string, part int, data binary")


def whole_chunks(spark: SparkSession, path: str, encoding: str, in_parts: bool = False) -> DataFrame:
    """The same from files whose line ends aren't single bytes: one row a file, as UTF-8."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = data.as_buffer().to_pybytes().decode(encoding, "replace").removeprefix("\ufeff")
                row = ("" if in_parts else file, _place(file, 0), 0, text.removesuffix("\n").encode())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _CHUNK.values(), strict=True)], list(_CHUNK))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, block string, part int, data binary")


def _lines(data: bytes, encoding: str) -> list[str]:
    return [line.removesuffix("\r") for line in data.decode(encoding, "replace").split("\n")]


def scanned(packed: DataFrame, delimiter: str, encoding: str) -> DataFrame:
    """file, block, part, state, first (number of the first record that begins there) of each chunk.

    A map is the identity, an exchange of both states, or has one result for both. The state of a chunk is the result
    of the last one before it of that last kind, exchanged as often as exchanges follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [summary(_lines(d.as_buffer().to_pybytes(), encoding), delimiter) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "block", "part")), *(pa.array([m[s][i] for m in maps], pa.int64()) for s in (OUTSIDE, INSIDE) for i in (0, 1))], ["file", "block", "part", "to0", "n0", "to1", "n1"])

    maps = packed.mapInArrow(run, "file string, block string, part int, to0 long, n0 long, to1 long, n1 long")
    earlier = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("to0") == F.col("to1"), F.col("to0"))
    run_of = F.coalesce(F.count(fixed).over(earlier), F.lit(0))
    known = maps.select("*", fixed.alias("fixed"), run_of.alias("run"), F.coalesce(F.last(fixed, ignorenulls=True).over(earlier), F.lit(OUTSIDE)).alias("base"))
    since = Window.partitionBy("file", "run").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    exchanged = F.when(F.col("fixed").isNull() & (F.col("to0") == INSIDE), 1).otherwise(0)
    states = known.withColumn("state", (F.col("base") + F.coalesce(F.sum(exchanged).over(since), F.lit(0))) % 2)
    begun = F.when(F.col("state") == OUTSIDE, F.col("n0")).otherwise(F.col("n1"))
    return states.select("file", "block", "part", F.col("state").cast("int").alias("state"), F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("first"))


def read_records(packed: DataFrame, delimiter: str, encoding: str) -> DataFrame:
    """file, record (from 0, blank lines count), cells of each record of the files."""

    def parse(texts: list[str]) -> list[list[str]]:
        csv.field_size_limit(sys.maxsize)
        return [next(csv.reader(io.StringIO(t, newline=""), delimiter=delimiter), []) for t in texts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = _lines(row["data"], encoding)
                if row["part"] == 0 and row["block"].endswith(":" + "0" * 20):
                    lines[0] = lines[0].removeprefix("\ufeff")
                found = list(records(lines, row["state"], delimiter))
                whole = [begins and ends for _, _, begins, ends in found]
                cells = iter(parse([t for (_, t, _, _), w in zip(found, whole, strict=True) if w]))
                columns = [
                    [row["file"]] * len(found), [row["first"] + n - (not begins) for n, _, begins, _ in found], [next(cells) if w else None for w in whole],
                    [None if w else {"block": row["block"], "part": row["part"]} for w in whole], [None if w else t for (_, t, _, _), w in zip(found, whole, strict=True)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RECORD_ARROW, strict=True)], ["file", "record", "cells", "piece", "text"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parse(batch.column(2).to_pylist()), pa.list_(pa.string()))], ["file", "record", "cells"])

    rows = packed.join(scanned(packed, delimiter, encoding), ["file", "block", "part"]).mapInArrow(cut, _RECORD)
    pieces = rows.where("cells is null").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    texts = pieces.select("file", "record", F.array_join(F.col("p.text"), "\n").alias("text"))
    return rows.where("cells is not null").select("file", "record", "cells").unionByName(texts.mapInArrow(joined, "file string, record long, cells array<string>"))
