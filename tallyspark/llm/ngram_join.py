"""Jaccard join on word n-grams by rare-first prefixes.

Two texts link when 100 * |A and B| >= pct * |A or B| over their sets of word n-grams.

1. A first pass counts all n-grams of all texts into a table of ``2**sketch_bits`` counters (a fixed
   size, whatever the input). It only orders n-grams: rare first, then by hash. Any order that all
   texts share gives right results; a better one gives fewer candidates.
2. A second pass reduces each text to its set size, a 128-bit digest of the set, 1,024 parity bits and
   the prefix: the first ``n - ceil(pct * n / 100) + 1`` n-grams in that order. Two texts that link
   share an n-gram of their prefixes. Texts with equal sets become one representative.
3. Prefix entries whose n-gram another representative has too get the parities of what lies before
   it and of the suffix after it. Entries are joined on the n-gram, and pairs must pass three
   filters: lengths; the positions of the shared n-gram, which bound how many n-grams can be shared
   before and after it; and the suffixes (and what lies before), where each n-gram that only one
   side has flips one parity bit, so that the bits that differ bound what is shared. What is left
   must pass the same bound over all 1,024 bits of both sets. Before that, pairs are counted: a pair
   shares no more n-grams than those of both prefixes and the longer suffix, and of the prefixes no
   more than the n-grams that it alone has in common and the others that each side has.
4. Stars: each holder of an n-gram meets three pivots of that n-gram: the holder whose n-grams are the
   most frequent (in a group of edited copies, the one that was edited least), the one with the
   smallest id and one chosen by a hash. That is linear in the entries. The pairs are verified, each
   once, and give provisional components.
5. Strays: where the holders of an n-gram (three or more; of two, the pair has been met) are of several components, those outside the n-gram's
   largest component meet all its holders of other components. Pairs that pass the filters and were
   not met before are verified, each once. A pair inside one component can't change it and is not
   made. So no link between components is lost, and a large group of copies does not become all of
   its pairs.

Only texts of pairs are shuffled: a bitmap of fixed size over hashes of their ids is broadcast, and
texts that it doesn't have are dropped where they are read. What it lets through by chance is dropped
by the join.

Defined cases: a text with fewer words than an n-gram has its whole word sequence as one n-gram; a
text without words (or null) has none, links with nothing and is its own component. Rows that
repeat an id are one document, each of whose texts may link. Rows without an id link with nothing;
their component is that of a document with an equal set, else null. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents
from .components import components
from .shingles import mix, shared, shingle_sets

CHUNK = 1 << 16
_SIGNS = ["s0", "s1", "s2", "s3"]
#: Words of 64 parity bits of a whole set; an entry has them folded to four.
PARITY_WORDS = 16
#: Bits of the broadcast bitmap of ids: 1 MB.
BITMAP_BITS = 1 << 23
_BEFORE = ["b0", "b1"]


def _packed(counts: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}")


def _count(words: int, bits: int):
    """Counters of one task, in chunks."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros(1 << bits, np.uint32), np.uint32(1)
        for batch in batches:
            for _, _, hashes, _ in shingle_sets(batch.column(0), words):
                np.add.at(total, (hashes >> shift).astype(np.int64), one)
        for i in range(0, len(total), CHUNK):
            if (chunk := total[i : i + CHUNK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([_packed(chunk)], pa.binary())], ["chunk", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = _unpacked(counts.as_py()).astype(np.int64)
            sums[chunk] = sums[chunk] + more if chunk in sums else more
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(c) for c in sums.values()], pa.binary())], ["chunk", "counts"])


def ngram_counts(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """2**bits counters over all n-grams of all texts, a fixed 4 * 2**bits bytes."""
    parts = texts.select("text").mapInArrow(_count(words, bits), "chunk int, counts binary")
    rows = parts.repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary").collect()  # 2**bits / CHUNK rows
    out = np.zeros(1 << bits, np.uint32)
    for chunk, counts in rows:
        part = np.minimum(_unpacked(bytes(counts)).astype(np.int64), np.iinfo(np.uint32).max)
        out[chunk * CHUNK : chunk * CHUNK + len(part)] = part
    return out


def _parities(hashes: np.ndarray, words: int = 4) -> Iterator[np.ndarray]:
    """For each word (a power of two of them), the bit that each hash flips in it."""
    bit, word = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) & np.uint64(words - 1)
    for j in range(words):
        yield np.where(word == j, bit, np.uint64(0))


_REDUCED = "doc_id long, n int, h1 long, h2 long, common float, parity array<long>, prefix array<long>"


def _reduce(words: int, pct: int, bits: int, counts):
    """Each text as a row of _REDUCED; common is the mean logarithm of its n-grams' counters."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for lo, hi, hashes, ends in shingle_sets(batch.column(1), words):
                n = np.diff(ends)
                some = np.flatnonzero(n)
                at = ends[:-1][some]
                size = np.where(n > 0, n - -(-pct * n // 100) + 1, 0)
                rank = table[(hashes >> shift).astype(np.int64)]
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                prefix = np.empty(offsets[-1], np.uint64)
                for r in some:
                    a = ends[r]
                    prefix[offsets[r] : offsets[r + 1]] = hashes[a + np.argsort(rank[a : ends[r + 1]], kind="stable")[: size[r]]]
                digest, common, parity = np.zeros((2, hi - lo), np.uint64), np.zeros(hi - lo, np.float32), np.zeros((hi - lo, PARITY_WORDS), np.uint64)
                if len(at):
                    digest[0, some] = np.add.reduceat(mix(hashes), at)
                    digest[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for j, bits_of_word in enumerate(_parities(hashes, PARITY_WORDS)):
                        parity[some, j] = np.bitwise_xor.reduceat(bits_of_word, at)
                    common[some] = np.add.reduceat(np.log2(1 + rank.astype(np.float64)), at) / n[some]
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.view(np.int64))) for o, v in ((np.arange(hi - lo + 1) * PARITY_WORDS, parity.reshape(-1)), (offsets, prefix))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digest), pa.array(common), *lists], ["doc_id", "n", "h1", "h2", "common", "parity", "prefix"])

    return run


def _verify(words: int, pct: int, piece: int = 4 << 20):
    """The pairs whose texts link."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [h[e[i] : e[i + 1]] for lo, hi, h, e in shingle_sets(texts, words) for i in range(hi - lo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + piece)))
                part = batch.slice(at, end - at)
                hits = []
                for i, (x, y) in enumerate(zip(sets(part.column(2)), sets(part.column(3)), strict=True)):
                    both = shared(x, y)
                    if both and 100 * both >= pct * (len(x) + len(y) - both):
                        hits.append(i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hits, pa.int32())), part.column(1).take(pa.array(hits, pa.int32()))], ["a", "b"])
                at = end

    return run


_ENTRIES = "token long, id long, n int, pos int, many int, alone boolean, common float, b0 long, b1 long, s0 long, s1 long, s2 long, s3 long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, common, parity, prefix, at) into a row of _ENTRIES for each position in at.

    A position p at which only one other representative has the n-gram (alone) comes as -1 - p; many is
    the number of the other positions.
    """
    names = ["token", "id", "n", "pos", "many", "alone", "common", *_BEFORE, *_SIGNS]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float32(), *[pa.int64()] * 6]
    for batch in batches:
        facts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        out: list[list[np.ndarray]] = [[] for _ in names]
        for r, (parity, prefix, at) in enumerate(zip(*(batch.column(i) for i in (3, 4, 5)), strict=True)):
            whole = np.bitwise_xor.reduce(parity.values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 4), 0)
            tokens, marks = prefix.values.to_numpy(zero_copy_only=False).view(np.uint64), at.values.to_numpy(zero_copy_only=False)
            alone = marks < 0
            pos = np.where(alone, -1 - marks, marks)
            upto = np.stack([np.bitwise_xor.accumulate(p) for p in _parities(tokens)])[:, pos]
            before = upto ^ np.stack(list(_parities(tokens[pos])))
            same = lambda x, n=len(pos): np.repeat(x, n)
            columns = [tokens[pos], *(same(f[r]) for f in facts[:2]), pos, same((~alone).sum()), alone, same(facts[2][r]), before[0] ^ before[2], before[1] ^ before[3], *(upto ^ whole[:, None])]
            for o, c in zip(out, columns, strict=True):
                o.append(c)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if (x := np.concatenate(o)).dtype == np.uint64 else x, k) for o, k in zip(out, kinds, strict=True)], names)


def _close(pct: int, a: str, b: str) -> str:
    """Length, positional and suffix filter for a pair of entries; a and b are prefixes of their column names.

    A pair links only if it shares at least pct / (100 + pct) of both sizes together.
    """
    (na, nb), (pa_, pb) = (f"{a}n", f"{b}n"), (f"{a}pos", f"{b}pos")
    differ = {part: " + ".join(f"bit_count({a}{w} ^ {b}{w})" for w in words) for part, words in (("before", _BEFORE), ("after", _SIGNS))}
    before = f"least({pa_}, {pb}, ({pa_} + {pb} - ({differ['before']})) div 2)"
    rest = f"{na} - {pa_} - 1", f"{nb} - {pb} - 1"
    positional = f"least({pa_}, {pb}) + 1 + least({rest[0]}, {rest[1]})"
    suffix = f"{before} + 1 + ({rest[0]} + {rest[1]} - ({differ['after']})) div 2"
    needed = f"{pct}L * ({na} + {nb})"
    return f"100L * least({na}, {nb}) >= {pct}L * greatest({na}, {nb}) and ({positional}) * {100 + pct}L >= {needed} and ({suffix}) * {100 + pct}L >= {needed}"


def _missing(pct: int, a: str, b: str) -> str:
    """How many n-grams that only these two have in common a pair needs to link."""
    (na, nb), (ma, mb) = (f"{a}n", f"{b}n"), (f"{a}many", f"{b}many")
    needed = f"(({pct}L * ({na} + {nb}) + {99 + pct}) div {100 + pct})"
    suffix = [f"(({pct}L * {n} + 99) div 100 - 1)" for n in (na, nb)]
    return f"{needed} - least({ma}, {mb}) - greatest({suffix[0]}, {suffix[1]})"


def _with_maybe(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows with _maybe: whether their id may be among ids (column id), by a broadcast bitmap of BITMAP_BITS."""

    def bit(of: str) -> Column:
        return F.pmod(F.xxhash64(F.col(of).cast("long")), F.lit(BITMAP_BITS)) + 1

    maps = ids.select(bit("id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    at = F.bitmap_bit_position(bit(id_col))
    octet = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit(id_col)) == F.col("_bucket"), "left")  # BITMAP_BITS at most
    return joined.withColumn("_maybe", F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False)))


def with_any_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be among ids: all of those that are, and few others, without a shuffle of texts."""
    return _with_maybe(texts, ids, "doc_id").where("_maybe").select(texts.columns)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among ids (column id). Only rows that may be among them are shuffled."""
    flagged = _with_maybe(docs, ids, id_col)
    gone = ids.select(F.col("id").alias("_gone"))
    kept = flagged.where("_maybe").join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
    return flagged.where("not _maybe").select(docs.columns).unionByName(kept.select(docs.columns))


def ngram_join(docs: DataFrame, words: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 22) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row."""
    spark = docs.sparkSession
    texts = documents(docs, id_col, text_col)
    with Scratch(spark, "ngram-join") as scratch:
        counts = spark.sparkContext.broadcast(ngram_counts(texts, words, sketch_bits))
        reduced = scratch.table(texts.mapInArrow(_reduce(words, pct, sketch_bits, counts), _REDUCED), "reduced")
        facts = ["common", "parity", "prefix"]
        reps = reduced.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in facts))
        reps = scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # an id may have several texts

        prefixes = reps.where("id is not null").select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
        holders = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("n").alias("least"), F.max("n").alias("most"))
        held = holders.where(f"holders > 2 or (holders = 2 and 100L * least >= {pct}L * most)")  # two holders must pass the length filter
        held = scratch.table(held.select("token", (F.col("holders") == 2).alias("alone")), "held")
        at = prefixes.join(held, "token").groupBy("rep").agg(F.collect_list(F.when(F.col("alone"), -1 - F.col("pos")).otherwise(F.col("pos"))).alias("at"))
        entries = reps.join(at, "rep").select("id", "n", *facts, "at").mapInArrow(_entries, _ENTRIES)
        entries = scratch.table(entries, "entries")
        pivots = entries.groupBy("token").agg(
            F.max(F.struct("common", (-F.col("id")).alias("id")))["id"].alias("p1"), F.min("id").alias("p2"), F.min(F.struct(F.xxhash64("id", "token").alias("order"), "id"))["id"].alias("p3"), F.count(F.lit(1)).alias("holders")
        )
        # of two holders one is enough
        pivots = pivots.withColumn("p1", -F.col("p1")).select("token", "p1", *(F.when(F.col("holders") > 2, F.col(p)).otherwise(F.col("p1")).alias(p) for p in ("p2", "p3")))
        pivots = scratch.table(pivots, "pivot-ids")
        met = ["id", "n", "pos", "many", *_BEFORE, *_SIGNS]
        pivots = entries.join(pivots, "token").where("id in (p1, p2, p3)").select("token", *(F.col(c).alias(f"p_{c}") for c in met))
        pivots = scratch.table(pivots, "pivots")

        def close_pairs(pairs: DataFrame, name: str) -> DataFrame:
            """Of pairs (a, b), each once, those that all parity bits leave possible."""
            sides = [reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}")) for s in "ab"]
            differ = "aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
            possible = f"((n_a + n_b - {differ}) div 2) * {100 + pct}L >= {pct}L * (n_a + n_b)"
            return scratch.table(pairs.join(sides[0], "a").join(sides[1], "b").where(possible).select("a", "b"), name)

        def verified(pairs: DataFrame, name: str) -> DataFrame:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            picked = scratch.table(with_any_of(texts, ids), f"texts-of-{name}")
            with_b = pairs.join(picked.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            with_a = with_b.join(picked.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            links = scratch.table(with_a.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, pct), "a long, b long"), name)
            scratch.drop(f"texts-of-{name}")
            return links

        met_pairs = entries.join(pivots, "token").where(f"id != p_id and {_close(pct, 'p_', '')}")
        met_pairs = met_pairs.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"), F.col("alone").cast("int").alias("alone"), F.expr(_missing(pct, "p_", "")).alias("missing"))
        enough = met_pairs.groupBy("a", "b").agg(F.sum("alone").alias("alone"), F.min("missing").alias("missing")).where("alone >= missing")
        stars = close_pairs(enough.select("a", "b"), "stars")
        scratch.drop("pivots")
        groups = components(verified(stars, "links"), scratch, "groups")

        def with_component(rows: DataFrame) -> DataFrame:
            return rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))

        shared_by_more = entries.where("not alone").drop("common", "alone")
        parts = with_component(shared_by_more.select("token", "id")).groupBy("token", "component").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts"))
        split = scratch.table(parts.where("parts > 1").select("token", "main"), "split")
        across = scratch.table(with_component(shared_by_more.join(split, "token")), "across")
        a, b = (across.select("token", "main", *(F.col(c).alias(f"{s}_{c}") for c in [*met, "component"])) for s in "ab")
        strays = a.where("a_component != main").drop("main")
        condition = f"a_component != b_component and (b_component = main or a_id < b_id) and {_missing(pct, 'a_', 'b_')} <= 0 and {_close(pct, 'a_', 'b_')}"
        pairs = strays.join(b, (strays["token"] == b["token"]) & F.expr(condition)).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
        pairs = close_pairs(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
        final = groups
        if not pairs.isEmpty() and not (more := verified(pairs, "more-links")).isEmpty():
            joined = more.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            bridges = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch, "bridges")
            moved = groups.join(bridges.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
            moved = moved.select("id", F.coalesce("root", "component").alias("component"))
            alone = bridges.join(groups.select("id"), "id", "left_anti")
            final = scratch.table(moved.unionByName(alone), "final")
        placed_reps = reps.select("n", "h1", "h2", "id").join(final, "id", "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
        full = reduced.where("n > 0").select("doc_id", "n", "h1", "h2").join(scratch.table(placed_reps, "placed-reps"), ["n", "h1", "h2"])
        empty = reduced.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        out = full.select("doc_id", "n", "component_id").unionByName(empty)
        out = scratch.keep(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))
        counts.destroy()
        return out
