"""Alignment of two tokenizers' tokens: byte-level BPE (A) and sentencepiece BPE with byte fallback (B).

Both encode a space and the text. Each byte gets a label: nothing ends here, an A token ends, a B token
ends, both end. A regular expression cuts the label string after each both-label; the labels inside a
cut count its A and B tokens, which form a group. Two tokens overlap in one stretch without an end of
either inside it, so each label other than "nothing" closes exactly one link (the A and the B token that
cover that byte), and all links of a text come from its labels without looking at pairs.

How often two ids are linked in all texts decides which link is a B id's best:

1. one pass encodes and writes for each text its digest and its distinct linked ids with their numbers;
2. those are summed by pair of ids, and each B id's largest sum is found (no more rows than B has ids);
3. the ``hot`` most frequent pairs (a fixed number) go to all tasks, which sum what their texts have of
   them; the other pairs, which are rare, are joined.

Defined cases: a text has no tokens if it is null or empty, or if the joined bytes of A's or B's tokens are not
those of a space and the text: its numbers are zero and its groups' digest is empty. Special tokens'
strings are plain text. Equal rows each give a row and each count; rows without a doc_id are aligned
too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Ranks, ranks
from .common import Scratch, documents

A_END, B_END, BOTH = 1, 2, 3
_GROUP = re.compile(rb"[^\x03]*\x03")
#: Pairs of ids that are sent to all tasks: about 1 MB.
HOT = 1 << 16


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_MODELS: dict[tuple[str, str], tuple[Ranks, Pieces]] = {}


def _models(a_path: str, b_path: str) -> tuple[Ranks, Pieces]:
    if (a_path, b_path) not in _MODELS:
        _MODELS[a_path, b_path] = ranks(a_path, special=False), Pieces(b_path)
    return _MODELS[a_path, b_path]


def labels(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The label of each byte, from the tokens' sizes in bytes (none is 0, both sums are equal)."""
    out = np.zeros(int(a_sizes.sum()), np.uint8)
    out[np.cumsum(a_sizes) - 1] = A_END
    out[np.cumsum(b_sizes) - 1] += B_END
    return out


def groups_and_links(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many A and how many B tokens each group has; the number of the A token and of the B token of each link, in order."""
    own = label[label != 0]  # bytes at which nothing ends count for no group
    a, b = own & A_END, own >> 1
    a_upto, b_upto = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    last = np.cumsum(np.fromiter(map(len, _GROUP.findall(own.tobytes())), np.int64)) - 1
    return np.diff(a_upto[last], prepend=0), np.diff(b_upto[last], prepend=0), a_upto - a, b_upto - b


_DIGITS: dict[tuple[int, str], np.ndarray] = {}


def _digits(n: int, after: str) -> np.ndarray:
    """The numbers below n in decimal, each with a character after it, padded with zero bytes."""
    if (n, after) not in _DIGITS:
        _DIGITS[n, after] = np.array([f"{i}{after}".encode() for i in range(n)], f"S{len(str(n)) + 1}")
    return _DIGITS[n, after]


def written(a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, most: int) -> bytes:
    """The groups as a1,a2|b1;a3|b2,b3; most: all ids are below it."""
    a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
    out = np.empty(len(a_ids) + len(b_ids), _digits(most, ",").dtype)
    for ids, sizes, end, before, mark in ((a_ids, n_a, a_end, b_end - n_b, "|"), (b_ids, n_b, b_end, a_end, ";")):
        text = _digits(most, ",")[ids]
        text[end - 1] = _digits(most, mark)[ids[end - 1]]
        out[np.arange(len(ids)) + np.repeat(before, sizes)] = text
    return out.tobytes().replace(b"\0", b"")[:-1]


def align(a: Ranks, b: Pieces, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """A's ids, B's ids and the labels of each text; None for a text without tokens."""
    for text, b_list in zip(texts, b.encode(texts), strict=True):
        if not text:
            yield None
            continue
        whole = " " + text
        a_ids, b_ids, want = np.array(a.encode(whole), np.int64), np.array(b_list, np.int64), whole.encode()
        if a.sizes[a_ids].sum() != len(want) or b"".join(map(b.bytes.__getitem__, b_list)) != want:
            yield None
            continue
        yield a_ids, b_ids, labels(a.sizes[a_ids], b.sizes[b_ids])


_DIGEST = {"row": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row.

    n_best: links of the row whose pair of ids is linked in all rows as often as any pair with that B id;
    count_sum: how often in all rows, summed over the row's links.
    """
    spark = docs.sparkSession
    n_b = _models(a_path, b_path)[1].model.get_piece_size()
    n_a = len(_models(a_path, b_path)[0].bytes)
    kind, arrow = ("int", pa.int32()) if n_a * n_b < 1 << 31 else ("long", pa.int64())  # a pair of ids is one number
    scratch = Scratch(spark, "alignment")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _models(a_path, b_path)
        for batch in batches:
            rows, keys, counts = [], [], []
            for found in align(a, b, batch.column(2).to_pylist()):
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    keys.append(np.zeros(0, np.int64))
                    counts.append(np.zeros(0, np.int64))
                    continue
                a_ids, b_ids, label = found
                of_a, of_b, x, y = groups_and_links(label)
                key, n = np.unique(a_ids[x] * n_b + b_ids[y], return_counts=True)
                keys.append(key)
                counts.append(n)
                rows.append((len(a_ids), len(b_ids), len(of_a), len(x), hashlib.sha256(written(a_ids, b_ids, of_a, of_b, max(n_a, n_b))).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)] if rows else [pa.array([], k) for k in (*[pa.int64()] * 4, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, _lists(keys, arrow), _lists(counts, pa.int32())], [*_DIGEST, "keys", "ns"])

    texts = documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    digests = scratch.table(texts.mapInArrow(encode, ", ".join(f"{c} {t}" for c, t in _DIGEST.items()) + f", keys array<{kind}>, ns array<int>"), "digests")

    totals = digests.select(F.explode(F.arrays_zip("keys", "ns")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.ns").alias("total"))
    totals = scratch.table(totals, "totals")
    most = totals.groupBy((F.col("key") % n_b).alias("b")).agg(F.max("total").alias("most"))  # at most n_b rows
    totals = scratch.table(totals.withColumn("b", F.col("key") % n_b).join(F.broadcast(most), "b").select("key", "total", (F.col("total") == F.col("most")).alias("best")), "judged")
    first = sorted((r["key"], r["total"], r["best"]) for r in totals.orderBy(F.desc("total"), "key").limit(hot).collect())
    frequent = spark.sparkContext.broadcast(tuple(np.array([f[i] for f in first], np.int64) for i in range(3)))

    def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands among the frequent ones, and whether it does."""
        known = frequent.value[0]
        if not len(known):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return at, known[at] == key

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the batch, key and number of each pair."""
        keys, ns = batch.column("keys"), batch.column("ns")
        sizes = np.diff(keys.offsets.to_numpy())
        return np.repeat(np.arange(len(sizes)), sizes), keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ns.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, n = flat(batch)
            at, hit = places(key)
            out = np.zeros((2, batch.num_rows), np.int64)
            if hit.any():
                np.add.at(out[0], row[hit], n[hit] * frequent.value[2][at[hit]])
                np.add.at(out[1], row[hit], n[hit] * frequent.value[1][at[hit]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DIGEST), pa.array(out[0]), pa.array(out[1])], [*_DIGEST, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, n = flat(batch)
            keep = ~places(key)[1]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row[keep])), pa.array(key[keep], arrow), pa.array(n[keep])], ["row", "key", "n"])

    known = digests.mapInArrow(sums, ", ".join(f"{c} {t}" for c, t in _DIGEST.items()) + ", n_best long, count_sum long")
    others = digests.select("row", "keys", "ns").mapInArrow(rare, f"row long, key {kind}, n long").join(totals, "key")
    others = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("total")).alias("more_sum"))
    result = known.join(others, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
    with scratch:
        return scratch.keep(result)
