"""WARC archives with an index, written and read by Spark tasks.

Writing: each task writes one archive of gzip members (one a record) into a folder that all
executors share and returns an index row for each record: archive, offset, length, id, URL, digest.
A task that runs again writes another archive under a new name; only archives named in the index
count, and the others are removed once the index is written. Records whose payload repeats are
revisit records that name the response.

Reading: index first. The index rows of the wanted records are grouped by archive and stretch of
``stretch`` bytes, sorted by offset, and neighbouring ranges are read as one. The number of tasks
follows the bytes to be read, not those of the index.

Defined cases: a null html is an empty payload. Payloads of at least ``min_bytes`` bytes are equal
if their SHA-1 digests and lengths are; of equal ones the record with the smallest page_id is the
response and others revisit it; smaller payloads are all responses. A row without a page_id is
never named as the response: it revisits an equal payload that has one, else it is a response.
Rows that repeat a page_id and payload count as the same page: all are responses if one is. An empty
table gives no rows. Line breaks in URLs are escaped. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _fs, bounded_batches

GAP = 64 << 10
#: Archive bytes that one task reads, about.
READ_BYTES = 128 << 20
_INDEX = "archive string, offset long, length long, page_id long, url string, digest string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC 1.1 record."""
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def _write(folder: str):
    """Rows (page_id, url, html, sha1, refers_to, is_revisit) into one archive; yields its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha1, refers_to, is_revisit in zip(*(batch.column(i) for i in range(6)), strict=True):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    member = _gzip(record(page_id.as_py(), url.as_py(), payload, digest, refers_to.as_py(), is_revisit.as_py()))
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((name, offset, len(member), page_id.as_py(), url.as_py(), digest))
                    offset += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["archive", "offset", "length", "page_id", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write a record for each page into folder, which it has to itself, and return the index."""
    bounded_batches(pages.sparkSession)
    with Scratch(pages.sparkSession, "warc") as own:
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
        rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
        digests = own.table(rows.select("page_id", "sha1", "n_bytes"), "digests")
        same = digests.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
        again = digests.join(same.drop("n"), ["sha1", "n_bytes"]).where("page_id is null or page_id != refers_to")
        # one row for each page and payload, so that the join below gives each page once
        again = own.table(again.select("page_id", "sha1", "n_bytes", "refers_to").distinct(), "again")
        one = F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.sha1") == F.col("a.sha1")) & (F.col("p.n_bytes") == F.col("a.n_bytes"))
        marked = rows.alias("p").join(again.alias("a"), one, "left")
        marked = marked.select("p.page_id", "p.url", "p.html", "p.sha1", "a.refers_to", F.col("a.refers_to").isNotNull().alias("is_revisit"))
        index = (scratch or own).keep(marked.mapInArrow(_write(folder), _INDEX), "index")
        _remove_others(index, folder)
        return index


def _remove_others(index: DataFrame, folder: str) -> None:
    """Delete what tasks that ran again have left; there is one archive a task, so the names are few."""
    named = {r["archive"] for r in index.select("archive").distinct().collect()}
    fs, path = _fs(index.sparkSession, folder)
    for status in fs.listStatus(path):
        if status.getPath().getName() not in named:
            fs.delete(status.getPath(), False)


def _read(folder: str, most: int):
    """Index rows in the order of (archive, offset): neighbours are read as one range."""

    def ranges(batches: Iterator[pa.RecordBatch]):
        run = None
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run and run[0] == archive and offset <= run[2] + GAP and offset + length - run[1] <= most:
                    run[2] = max(run[2], offset + length)
                    run[3].append((offset, length))
                else:
                    if run:
                        yield run
                    run = [archive, offset, offset + length, [(offset, length)]]
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        opened, source = None, None
        for archive, start, end, members in ranges(batches):
            if archive != opened:
                source, opened = fs.open_input_file(f"{base}/{archive}"), archive
            data = source.read_at(end - start, start)
            rows = []
            for offset, length in members:
                fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                page, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "")[10:-1]
                revisit = fields["WARC-Type"] == "revisit"
                n, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and (len(payload) != n or sha1_base32(payload) != digest):
                    raise ValueError(f"record at {offset} of {archive} does not match its digest")
                rows.append((int(page) if page else None, n, digest, fields["WARC-Type"], int(refers) if refers else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_records(index: DataFrame, folder: str, stretch: int = 8 << 20) -> DataFrame:
    """The records that the index rows name, whatever selection of them."""
    grouped = index.select("archive", "offset", "length", (F.col("offset") / stretch).cast("long").alias("stretch"))
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    ordered = grouped.repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    return ordered.mapInArrow(_read(folder, stretch), _RECORDS)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page, then read every record back."""
    scratch = Scratch(pages.sparkSession, "warc-files")
    folder = scratch.folder("archives")
    return read_records(write_archives(pages, folder, min_bytes, scratch=scratch), folder)
