"""Line deduplication by range-partitioned hashes and keep bitmaps.

1. Each text becomes rows (line hash, document, position), one for each line that is long enough.
2. The rows are range-partitioned by (hash, document, position) and sorted, so that one very
   common line spreads over many partitions. Each partition is streamed once: after the first
   document of a hash, every later row is a line to drop.
3. A hash may run on from the partition before. The rows of a partition's first hash that belong to
   the first document seen there stay open; with the last hash of every partition they are few
   (one document's worth a partition) and are settled by one small grouping.
4. The dropped positions of a document become a zlib-compressed keep bitmap. Texts are not moved
   for this; ``apply_bitmaps`` joins bitmaps and texts where the kept text itself is wanted.

Defined cases: a null or empty text is one empty line; a line's key is the line without ASCII
blanks at both ends and with A-Z in lower case; shorter keys than ``min_chars`` code points are
kept; all lines with one key in the smallest document that has it stay. Rows that repeat a doc_id
are one document for this purpose and keep their own texts. Rows without a doc_id count as one
document that comes before all others. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, documents

_BLANKS = b" \t\n\x0b\x0c\r"
_ABSENT = -(2**63)
_CONTINUATION = re.compile(rb"[\x80-\xbf]")


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and key of each line that is long enough."""
    for i, line in enumerate(text.encode().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(_BLANKS).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key) - len(_CONTINUATION.findall(key)) >= min_chars):
                yield i, key


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                hashes, rows, positions = bytearray(), [], []
                while at < len(texts) and len(positions) < 50_000:
                    before = len(positions)
                    for i, key in line_keys(texts[at].as_py(), min_chars):
                        hashes += xxhash.xxh3_128_digest(key)
                        positions.append(i)
                    rows += [at] * (len(positions) - before)
                    at += 1
                two = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, 0]), pa.array(two[:, 1]), ids.take(pa.array(rows, pa.int64())), pa.array(positions, pa.int32())], ["h1", "h2", "doc_id", "pos"]
                )

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (h1, h2, doc_id, pos): emits drops (state 0), rows that stay open (1) and the last hash (2)."""
    key = doc = first = None
    opening, some = True, False
    for batch in batches:
        h1, h2, d, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = len(p)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = not some or key != (h1[0], h2[0])
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: goes on from the batch before
        firsts = np.append(d[at], first if some else 0)[run]
        drop = d != firsts
        in_first_run = (run == (-1 if some else 0)) & opening
        still_open = ~drop & in_first_run
        opening = bool(in_first_run[-1])
        key, first, some = (h1[-1], h2[-1]), firsts[-1], True
        take = np.flatnonzero(drop | still_open)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[take], h2[take], d[take], p[take], still_open[take].astype(np.int32))], ["h1", "h2", "doc_id", "pos", "state"])
    if some:
        last = [np.array([x]) for x in (key[0], key[1], first)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*last, np.array([-1], np.int32), np.array([2], np.int32))], ["h1", "h2", "doc_id", "pos", "state"])


def _bitmap(positions: np.ndarray) -> bytes:
    """One bit a line, in whole bytes up to the last line dropped; set where the line stays."""
    keep = np.ones(-(-(int(positions.max()) + 1) // 8) * 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, bitmap for each document that loses a line."""
    rows = documents(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_ABSENT)))
    order = ["h1", "h2", "doc_id", "pos"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(docs.sparkSession, "line-dedup") as own:
        # written, so that the sampling for the ranges does not hash all lines a second time
        hashed = own.table(rows.mapInArrow(_hash_lines(min_chars), "h1 long, h2 long, doc_id long, pos int"), "hashed")
        streamed = hashed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream, "h1 long, h2 long, doc_id long, pos int, state int")
        streamed = own.table(streamed, "streamed")
        edges = streamed.where("state > 0")
        firsts = edges.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        settled = edges.where("state = 1").join(firsts.hint("merge"), ["h1", "h2"]).where("doc_id != first")
        drops = streamed.where("state = 0").select("doc_id", "pos").unionByName(settled.select("doc_id", "pos"))

        packed = drops.groupBy("doc_id").agg(F.collect_set("pos").alias("positions")).mapInPandas(
            lambda parts: (part.assign(bitmap=[_bitmap(np.asarray(p)) for p in part["positions"]])[["doc_id", "bitmap"]] for part in parts), "doc_id long, bitmap binary"
        )
        return (scratch or own).keep(packed, "bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``_bitmap``; texts move once, by id.

    Rows without an id lose no lines; they are spread by their texts and meet no bitmap.
    """
    bounded_batches(docs.sparkSession)
    keyed = bitmaps.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_has_id"), F.col("bitmap").alias("_bitmap"))
    own_id = F.col(id_col).cast("long")
    rows = docs.withColumns({"_id": F.coalesce(own_id, F.xxhash64(text_col)), "_has_id": own_id.isNotNull()})
    return rows.join(keyed.hint("merge"), ["_id", "_has_id"], "left").drop("_id", "_has_id")


def kept_text(text: str, bitmap: bytes | None) -> str:
    if not bitmap:
        return text
    lines = text.split("\n")
    keep = read_bitmap(bitmap, len(lines))
    return "\n".join(line for line, k in zip(lines, keep, strict=True) if k)


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        n_lines, dropped, digests = [], [], []
        for text, bitmap in zip(part["text"], part["_bitmap"], strict=True):
            n = text.count("\n") + 1
            n_lines.append(n)
            dropped.append(int((~read_bitmap(bitmap, n)).sum()) if bitmap else 0)
            digests.append(hashlib.sha256(kept_text(text, bitmap).encode()).hexdigest())
        yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_lines": n_lines, "n_dropped": dropped, "kept_sha256": digests})


def line_dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row."""
    bitmaps = keep_bitmaps(docs, min_chars, id_col, text_col)
    return apply_bitmaps(documents(docs, id_col, text_col), bitmaps).mapInPandas(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table itself with the repeated lines taken out of the text; all columns stay."""
    keep = F.pandas_udf(lambda text, bitmap: pd.Series([kept_text(t, b) if t is not None else None for t, b in zip(text, bitmap, strict=True)]), "string")
    marked = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, id_col, text_col), id_col, text_col)
    return marked.withColumn(text_col, F.when(F.col("_bitmap").isNull(), F.col(text_col)).otherwise(keep(text_col, "_bitmap"))).select(docs.columns)
