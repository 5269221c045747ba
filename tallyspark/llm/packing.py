"""Conflict-constrained best-fit packing of documents into bins of a fixed token capacity.

Sizes are tokens of a public vocabulary. Documents are cut into pieces of at most ``capacity`` tokens;
whole-capacity pieces are bins of their own. The rest is dealt by a hash into shards of about
``shard_pieces`` pieces (a parameter: there are more shards as the input grows, so a document's bin
depends on what else is packed), which are packed independently: the number of tasks grows with the
input, a task's memory does not, and each shard can leave only a few bins half empty. Inside a shard, pieces come by descending size and bins
are kept in the order of their residual. Each bin carries two bitmaps: the duplicate clusters that
it holds, and the sources that have reached ``per_source`` pieces in it. The search begins at the
smallest residual that fits (the successor of the size) and goes on to larger ones until a bin
conflicts in neither bitmap: that is the tightest compatible bin. If there is none, a bin is opened.

``best_fit_packing`` says where each piece goes; ``pack_tokens`` returns the bins themselves, as token
ids with the pieces that they hold.

Defined cases: a null or empty text has one piece of size 0, which takes part like any other; a null
source is a source of its own; two pieces of one document may not share a bin with each other's
cluster either; equal rows are documents of one cluster; rows without a doc_id are packed too. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec, ranks
from .common import Scratch, bounded_batches
from .exact_dedup import BLANKS

_PACKED = "row long, doc_id long, piece int, start long, size int, bin string, bin_offset int"


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # distinct residuals in order
        self.at: dict[int, list[int]] = {}  # bins of each residual, in the order of their numbers
        self.residual: list[int] = []
        self.clusters: list[int] = []  # bitmaps
        self.full_sources: list[int] = []
        self.counts: list[Counter] = []

    def _put(self, b: int, residual: int) -> None:
        self.residual[b] = residual
        if residual not in self.at:
            insort(self.residuals, residual)
            self.at[residual] = []
        insort(self.at[residual], b)

    def _take(self, b: int) -> None:
        r = self.residual[b]
        self.at[r].remove(b)
        if not self.at[r]:
            del self.at[r]
            self.residuals.pop(bisect_left(self.residuals, r))

    def add(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """Bin and offset for a piece; cluster and source are numbers within the shard (cluster -1: alone)."""
        c, s = 1 << cluster if cluster >= 0 else 0, 1 << source
        chosen = -1
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            chosen = next((b for b in self.at[self.residuals[i]] if not (self.clusters[b] & c or self.full_sources[b] & s)), -1)
            if chosen >= 0:
                break
        if chosen < 0:
            chosen = len(self.residual)
            self.residual.append(self.capacity)
            self.clusters.append(0)
            self.full_sources.append(0)
            self.counts.append(Counter())
        else:
            self._take(chosen)
        offset = self.capacity - self.residual[chosen]
        self.clusters[chosen] |= c
        self.counts[chosen][source] += 1
        if self.counts[chosen][source] >= self.per_source:
            self.full_sources[chosen] |= s
        self._put(chosen, self.residual[chosen] - size)
        return chosen, offset


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """rows: shard, row, doc_id, piece, start, size, source, cluster."""
    rows = rows.sort_values(["size", "cluster", "doc_id", "piece", "start", "row"], ascending=[False, True, True, True, True, True], kind="stable")
    repeated = rows["cluster"].duplicated(keep=False)
    clusters = pd.factorize(rows["cluster"].where(repeated))[0]
    sources = pd.factorize(rows["source"])[0]
    bins = Bins(capacity, per_source)
    placed = [bins.add(n, int(c), int(s)) for n, c, s in zip(rows["size"].tolist(), clusters, sources, strict=True)]
    shard = rows["shard"].iloc[0]
    return pd.DataFrame(
        {"row": rows["row"], "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "size": rows["size"], "bin": [f"{shard}-{b}" for b, _ in placed], "bin_offset": [o for _, o in placed]}
    )


def _placed(sized: DataFrame, capacity: int, per_source: int, shard_pieces: int) -> DataFrame:
    """sized: row, doc_id, n, source, cluster, a written table; gives rows of _PACKED."""
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))
    pieces = sized.select("*", F.explode(cut).alias("piece")).withColumn("start", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int"))
    alone = F.concat(F.lit("full-"), F.col("row").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    full = pieces.where(F.col("size") == capacity).select("row", "doc_id", "piece", "start", "size", alone.alias("bin"), F.lit(0).alias("bin_offset"))
    shards = max(1, -(-sized.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "piece", "row"), F.lit(shards)).cast("int").alias("shard")
    dealt = pieces.where(F.col("size") < capacity).select(shard, "row", "doc_id", "piece", "start", "size", "source", "cluster")
    return dealt.groupBy("shard").applyInPandas(lambda part: pack_shard(part, capacity, per_source), _PACKED).unionByName(full)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, cluster: Column | None) -> DataFrame:
    """row, doc_id, text, source, cluster."""
    bounded_batches(docs.sparkSession)
    cluster = F.xxhash64(F.regexp_replace("text", BLANKS, " ")) if cluster is None else cluster
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), source.alias("source"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source", cluster.alias("cluster"))


def best_fit_packing(
    docs: DataFrame, vocabulary: str, capacity: int = 8192, per_source: int = 4, shard_pieces: int = 2_000, source_col: str | None = "source",
    cluster: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, size, bin, bin_offset, in tokens: where each piece of each document goes.

    cluster: documents with one value never share a bin, by default the digest of the text with runs of
    blanks as one, so exact copies; near copies are kept apart by passing their component instead.
    """

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = ranks(vocabulary)
        for texts in parts:
            yield pd.Series([r.count(t) for t in texts], dtype="int64")

    rows = _rows(docs, id_col, text_col, source_col, cluster)
    with Scratch(docs.sparkSession, "packing") as scratch:
        sized = scratch.table(rows.select("row", "doc_id", tokens("text").alias("n"), "source", "cluster"), "sized")
        return scratch.keep(_placed(sized, capacity, per_source, shard_pieces).drop("row"))


def pack_tokens(
    docs: DataFrame, vocabulary: str, capacity: int = 8192, per_source: int = 4, shard_pieces: int = 2_000, source_col: str | None = "source",
    cluster: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """bin, n_tokens, ids (little-endian unsigned 32-bit integers), pieces (bin_offset, doc_id, piece, size) for each bin that holds a token."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for part in parts:
            yield part.assign(doc_id=part["doc_id"].astype("Int64"), ids=[c.encode(t) for t in part["text"]])[["row", "doc_id", "source", "cluster", "ids"]]
        c.forget()

    rows = _rows(docs, id_col, text_col, source_col, cluster)
    with Scratch(docs.sparkSession, "packing") as scratch:
        encoded = scratch.table(rows.mapInPandas(encode, "row long, doc_id long, source string, cluster long, ids binary"), "encoded")
        sized = encoded.select("row", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n"), "source", "cluster")
        placed = _placed(sized, capacity, per_source, shard_pieces).where("size > 0")
        part = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), F.col("size") * 4).alias("part")
        pieces = placed.join(encoded.select("row", "ids"), "row").select("bin", F.struct("bin_offset", "doc_id", "piece", "size", part).alias("one"))
        bins = pieces.groupBy("bin").agg(F.array_sort(F.collect_list("one")).alias("held"))  # a bin has at most capacity tokens
        ids = F.aggregate("held", F.lit(b""), lambda out, x: F.concat(out, x["part"]))
        held = F.transform("held", lambda x: F.struct(x["bin_offset"].alias("bin_offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["size"].alias("size")))
        return scratch.keep(bins.select("bin", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), held.alias("pieces")))
