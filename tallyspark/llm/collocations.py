"""Collocations by level-wise counting: phrases of two to five words that occur together more often than by chance.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into words at blanks. Everything is counted
per language.

1. Level 1 counts words. Level k counts the phrases of k words at whose place both overlapping phrases of k - 1
   words are frequent; others can't be frequent. The frequent ones of a level are broadcast as a bitmap of a
   fixed size over their hashes. What it lets through by chance is counted too and falls to the threshold, so counts
   are exact and a full bitmap costs time only. Phrases are told apart by their words, never by hashes.
2. Each batch of texts counts its own phrases on arrays; Spark adds the batches up before and after the shuffle.
3. Each frequent phrase is cut after each of its words. The parts of a frequent phrase are frequent, so their counts
   are in the level tables and come by joins.
4. A candidate is dropped if it lies inside a longer one that is as frequent; each candidate sends its parts the
   number of its occurrences, and the largest counts.

Defined cases: a null text counts as empty, a null language as ``und``; texts without words and empty tables give no
phrases; repeated rows count as often as they come; the id isn't used; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .shingles import _word_hashes, mix

#: Bits of a level's bitmap: 8 MB.
BITMAP_BITS = 1 << 26
#: Bits of a row of the bitmap while it is put together.
BUCKET_BITS = 1 << 15
#: A-Z to lower case; what ends a piece to a line end.
_TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.ones(256, bool)
_WORD[[9, 10, 32]] = False
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(lang: str, data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k neighbouring words a hash, and whether one piece has them all."""
    text = np.frombuffer(data, np.uint8)
    word = _WORD[text]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if len(starts) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    piece = np.cumsum(text == 10)[starts]
    own, n = _word_hashes(text, starts), len(starts) - k + 1
    out = np.full(n, int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()), np.uint64)
    for j in range(k):
        out = out * _GRAM + own[j : j + n]
    return mix(out), piece[:n] == piece[k - 1 :]


def phrases(lang: str, texts: list[str], k: int, bitmap: np.ndarray | None) -> tuple[list[str], np.ndarray]:
    """The distinct phrases of k words of some texts, and their numbers; by the bitmap only those whose parts may be frequent."""
    data = "\n".join(texts).encode().translate(_TABLE)
    if k == 1:
        counts = Counter(data.split())
        return _decoded(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    hashes, whole = gram_hashes(lang, data, k - 1)
    bit = hashes % np.uint64(len(bitmap) * 8)
    held = whole & ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(held[:-1] & held[1:])
    if k == 2:  # single words say nothing of what lies between them
        at = at[gram_hashes(lang, data, 2)[1][at]]
    if not len(at):
        return [], np.zeros(0, np.int64)
    used = np.zeros(len(hashes) + k - 1, bool)
    for j in range(k):
        used[at + j] = True
    some = list(compress(data.split(), used.tolist()))
    words = list(set(some))
    place = {w: i for i, w in enumerate(words)}
    ids = np.zeros(len(used), np.int64)
    ids[used] = np.fromiter(map(place.__getitem__, some), np.int64, len(some))
    code, steps = ids[at], []
    for j in range(1, k):
        code, distinct = pd.factorize(code * len(words) + ids[at + j])
        steps.append(distinct)
    counts, row, columns = np.bincount(code), np.arange(len(steps[-1])), []
    for distinct in reversed(steps):
        row, last = np.divmod(distinct[row], len(words))
        columns.append(last)
    rows = zip(*(map(words.__getitem__, c.tolist()) for c in [row, *reversed(columns)]), strict=True)
    return _decoded(list(map(b" ".join, rows))), counts


def _decoded(found: list[bytes]) -> list[str]:
    return b"\n".join(found).decode().split("\n") if found else []


def _count(k: int, bitmap):
    """For each batch and language: phrases with their numbers; at level 1 also the number of all words, without a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, own in texts.items():
                found, counts = phrases(lang, own, k, table)
                if k == 1 and found:
                    found, counts = [*found, None], np.append(counts, counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

    return run


def _places(k: int, bits: int):
    """Places of frequent phrases in the bitmap."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, own in part.groupby("lang", sort=False):
                hashes, whole = gram_hashes(lang, "\n".join(own["phrase"]).encode(), k)
                yield pd.DataFrame({"place": (hashes[whole] % np.uint64(bits)).astype(np.int64)})

    return run


def frequent_bitmap(level: DataFrame, k: int, bits: int = BITMAP_BITS) -> bytes:
    """A bitmap of fixed size over the hashes of a level's phrases."""
    place = level.select("lang", "phrase").mapInPandas(_places(k, bits), "place long")
    rows = place.groupBy((F.col("place") / BUCKET_BITS).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BUCKET_BITS).alias("bits")).collect()  # bits / BUCKET_BITS rows
    out = bytearray(bits // 8)
    step = BUCKET_BITS // 8
    for bucket, part in rows:
        out[bucket * step : (bucket + 1) * step] = part
    return bytes(out)


def _some(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int, longest: int, bits: int = BITMAP_BITS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, f of all phrases with f >= min_count, and lang, n with the number of all words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    levels, totals, bitmap = [], None, None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_count(k, bitmap), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        level = scratch.table(counted.where((F.col("f") >= min_count) | F.col("phrase").isNull()), f"level-{k}")
        if k == 1:
            totals = level.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
            level = level.where(F.col("phrase").isNotNull())
        levels.append(level.select("lang", F.lit(k).alias("k"), "phrase", "f"))
        if k < longest:
            bitmap = spark.sparkContext.broadcast(frequent_bitmap(level, k, bits))
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    return grams, totals


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, inside_pct: int = 100, top: int = 2000, bits: int = BITMAP_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score.

    a, l and r: occurrences of the phrase and of the two parts of its weakest cut; score: 1000 * a * n / (l * r),
    rounded down. Of cuts with equal scores the first counts. A phrase inside a longer one whose occurrences are at least
    inside_pct per cent of its own is left out.
    """
    with (scratch := Scratch(docs.sparkSession, "collocations")):
        grams, totals = frequent_phrases(docs, scratch, min_count, longest, bits, lang_col, text_col)
        words, k, size = F.split("phrase", " "), F.col("k"), F.col("size")
        candidates = grams.where(k >= 2)
        cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), "k", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
        cuts = cuts.select("lang", "phrase", "a", "cut", _some(F.col("words"), F.lit(1), F.col("cut")).alias("left"), _some(F.col("words"), F.col("cut") + 1, k - F.col("cut")).alias("right"))
        part = lambda name, count: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
        whole = lambda c: F.col(c).cast("decimal(18,0)")
        score = F.expr("CAST(over div under AS BIGINT)")
        scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
        scored = scored.withColumns({"over": (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "under": whole("l") * whole("r")})
        weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))

        longer = candidates.where(k >= 3).select("lang", "f", words.alias("words"), "k", F.explode(F.sequence(F.lit(2), k - 1)).alias("size"))
        longer = longer.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), k - size + 1)).alias("start"))
        longer = longer.groupBy("lang", _some(F.col("words"), F.col("start"), size).alias("phrase")).agg(F.max("f").alias("around"))
        kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_pct * F.col("a")))
        kept = kept.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return scratch.keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
