"""Exact top-k inner products by a score-at-a-time, impact-ordered, block-partitioned index.

Vectors are scaled to integers and dealt into blocks of bounded size by a hash of their row. A block's
components become posting segments: one for each quantised impact (the power of two below the
absolute value) and dimension, ordered by descending impact. The stated queries come in blocks too,
and every block of queries is held against every block of vectors: both have a bounded size, so a
task's memory does not grow with the tables.

The pairs of blocks are dealt into cells of a grid, vectors by strips and queries by slots. A block is
sent once to each cell of its strip or slot, not once for each pair, in the narrowest integers that
hold its values; nothing is broadcast or joined. A cell keeps its slot's blocks of queries, which are
few, and streams its strip's blocks of vectors past them.

Inside a pair of blocks the segments are processed score-at-a-time, by descending impact, for all
queries of the block that are still open. The work follows the number of postings. After each impact
level what is left of a score is bounded by ``|q| * |rest of v|`` (Cauchy-Schwarz). A query is closed
only when that proves that at most ``POSSIBLE * k`` vectors can be among its k best; they are then
rescored exactly. A query that is never closed has all its postings, and so exact scores. The k best
of a cell so far are kept for each query, and the last one's score is a floor for its later blocks;
those of all cells are merged by (score, id).

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id. An empty vector has the score 0 with every other. Each row is a vector of its own,
also where rows repeat an id: a query leaves out only its own row, and has a result for each of its
rows. Vectors of unequal length are compared as if the shorter one ended in zeros. A scaled
component or a score that doesn't fit into 64 bits is an error. Ties go to the smaller id; a query
with fewer than k candidates gets all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Bounds of a block: rows, and components of all its rows.
VECTORS, VECTOR_CELLS = 8192, 1 << 20
QUERIES, QUERY_CELLS = 512, 1 << 17
#: Bounds of a cell of the grid: pairs of blocks, and blocks of queries.
PAIRS, SLOT_BLOCKS = 1024, 64
#: A query is closed when at most so many times k vectors can be among its best.
POSSIBLE = 8
#: Whether to try to close queries after a level is judged by so many of them.
PROBES = 16
ROWS_AT_ONCE = 256
#: A level with at least one posting in so many cells of a block is added up as a whole, its segments side by side.
DENSE = 32


def scaled_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, x: floor(scale * component) as an array of long."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = lambda x: F.abs(x * F.lit(float(scale))) < F.lit(2.0**63)
    whole = F.transform(v, lambda x: F.when(fits(x), F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a scaled component does not fit into 64 bits")).cast("long")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def narrowed(x: np.ndarray) -> np.ndarray:
    """x in the narrowest signed integers that hold it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(f"<i{b}" for b in (1, 2, 4, 8) if -(1 << 8 * b - 1) <= low and high < 1 << 8 * b - 1))


def _blob(x: np.ndarray | list[int], kind: str = "<i8") -> pa.Array:
    return pa.array([np.asarray(x, kind).tobytes()], pa.binary())


def postings(m: np.ndarray) -> dict[str, np.ndarray]:
    """The segments of a block in the order in which they are processed."""
    row, dim = np.nonzero(m)
    value = m[row, dim]
    level = np.frexp(np.abs(value.astype(np.float64)))[1]
    order = np.lexsort((row, dim, -level))
    row, dim, value, level = row[order], dim[order], value[order], level[order]
    new = np.ones(len(row), bool)
    new[1:] = (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])
    begin = np.flatnonzero(new)
    return {"post_row": row.astype("<u2"), "post_value": narrowed(value), "seg_begin": begin.astype("<i4"), "seg_dim": dim[begin].astype("<i4"), "seg_level": level[begin].astype("<i4")}


_KINDS = {"post_row": "<u2", "seg_begin": "<i4", "seg_dim": "<i4", "seg_level": "<i4"}
#: A block of vectors (is_index) or of queries; x has its values in integers of x_bytes, of a matrix for queries, of postings for vectors.
_BLOCK = "block int, is_index boolean, width int, rows binary, ids binary, x_bytes int, x binary, " + ", ".join(f"{c} binary" for c in _KINDS)


def _blocks(is_index: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, ids, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                m = _matrix(x)
                index = postings(m) if is_index else {}
                values = index["post_value"] if is_index else narrowed(m)
                columns = [pa.array([block], pa.int32()), pa.array([is_index]), pa.array([m.shape[1]], pa.int32()), _blob(keys), _blob(ids), pa.array([values.itemsize], pa.int32()), _blob(values, values.dtype.str)]
                columns += [_blob(index.get(c, []), kind) for c, kind in _KINDS.items()]
                yield pa.RecordBatch.from_arrays(columns, ["block", "is_index", "width", "rows", "ids", "x_bytes", "x", *_KINDS])

    return run


def _exact(q: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Inner products of the rows of q and v, pairwise; most bounds their size."""
    if most < 1 << 63:
        return np.einsum("ij,ij->i", q, v)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in whole):
        raise OverflowError("a score does not fit into 64 bits")
    return np.array(whole, np.int64)


def best_of_pair(rows: np.ndarray, ids: np.ndarray, width: int, index: dict[str, np.ndarray], q_rows: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query index, vector index and score of the k best candidates of each query, and how many (posting, query) pairs were added up.

    Candidates with smaller scores than a query's floor are not looked for.
    """
    n, nq = len(rows), len(q_rows)
    width = max(width, q.shape[1])
    q = np.pad(q.astype(np.int64), ((0, 0), (0, width - q.shape[1])))
    floor = np.full(nq, -np.inf) if floor is None else floor
    row, value, dim, level = (index[c] for c in ("post_row", "post_value", "seg_dim", "seg_level"))
    bounds = [*index["seg_begin"].tolist(), len(row)]
    most = max(int(value.max(initial=0)), -int(value.min(initial=0))) * max(int(q.max(initial=0)), -int(q.min(initial=0))) * max(1, width)
    # what is added up in these kinds is exact; beyond 64 bits they are bounds, and all is rescored
    kind = np.float32 if most < 1 << 23 else np.float64
    loose = 2.0**-40 * float(most) if most >= 1 << 52 else 0.0
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    place = {int(r): i for i, r in enumerate(rows)}
    own = np.array([place.get(int(r), -1) for r in q_rows])
    levels = np.unique(level)[::-1]
    of_level = np.repeat(level, np.diff(bounds))
    squares = value.astype(np.float64) ** 2
    rest = np.zeros((len(levels), n))
    for i in range(len(levels) - 1, 0, -1):
        rest[i - 1] = rest[i] + np.bincount(row[of_level == levels[i]], squares[of_level == levels[i]], minlength=n)
    want, added = min(k, n), 0
    longest = np.sqrt(np.bincount(row, squares, minlength=n).max(initial=0))
    open_q, found = np.flatnonzero(longest * norms * 1.00001 + 1 + loose >= floor), []
    scores = np.zeros((n, len(open_q)), kind)

    def possible(columns: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Which vectors can be among the k best of the open queries in these columns."""
        slack = 1.0 + loose
        if left.any():
            slack = (np.sqrt(left)[:, None] * norms[open_q[columns]][None, :]) * 1.00001 + slack
        high = scores[:, columns] + slack
        mine = own[open_q[columns]]
        at = np.flatnonzero(mine >= 0)
        high[mine[at], at] = -np.inf
        may = (high >= floor[open_q[columns]]) & (high > -np.inf)
        if (may.sum(0) > POSSIBLE * k).any():  # the floors alone leave too many
            low = scores[:, columns] - slack
            low[mine[at], at] = -np.inf
            may &= high >= np.partition(low, n - want, axis=0)[n - want]
        return may

    segment = 0
    for i, lv in enumerate(levels):
        end = segment + int((level == lv).sum())
        at = slice(bounds[segment], bounds[end])
        if (at.stop - at.start) * DENSE >= n * width:
            whole = np.zeros((n, width), kind)
            whole[row[at], np.repeat(dim[segment:end], np.diff(bounds[segment : end + 1]))] = value[at]
            scores += whole @ q[open_q].astype(kind).T
            added += (at.stop - at.start) * len(open_q)
            segment = end
        while segment < end:
            weights = q[open_q, dim[segment]].astype(kind)
            for a in range(bounds[segment], bounds[segment + 1], ROWS_AT_ONCE):
                b = min(a + ROWS_AT_ONCE, bounds[segment + 1])
                scores[row[a:b]] += value[a:b].astype(kind)[:, None] * weights
            added += (bounds[segment + 1] - bounds[segment]) * len(open_q)
            segment += 1
        if i + 1 == len(levels) or n <= POSSIBLE * k or not len(open_q):
            continue
        probes = np.unique(np.linspace(0, len(open_q) - 1, PROBES).astype(int))
        if (possible(probes, rest[i]).sum(0) > POSSIBLE * k).mean() > 0.5:
            continue
        keep = np.ones(len(open_q), bool)
        for a in range(0, len(open_q), 64):
            columns = np.arange(a, min(a + 64, len(open_q)))
            may = possible(columns, rest[i])
            closed = may.sum(0) <= POSSIBLE * k
            who, which = np.nonzero(may.T & closed[:, None])
            found.append((open_q[columns[who]], which))
            keep[columns[closed]] = False
        if not keep.all():
            open_q, scores = open_q[keep], np.ascontiguousarray(scores[:, keep])
    for a in range(0, len(open_q), 64):
        who, which = np.nonzero(possible(np.arange(a, min(a + 64, len(open_q))), np.zeros(n)).T)
        found.append((open_q[a + who], which))
    who, which = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    full = np.zeros((n, width), np.int64)
    full[row, np.repeat(dim, np.diff(bounds))] = value
    score = np.concatenate([_exact(q[who[s : s + 16384]], full[which[s : s + 16384]], most) for s in range(0, len(who), 16384)] or [np.zeros(0, np.int64)])
    order = np.lexsort((ids[which], -score, who))
    who, which, score = who[order], which[order], score[order]
    take = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[take], which[take], score[take], added


class _Held:
    """A block of queries in a cell, with the k best of the vectors that have passed."""

    def __init__(self, one: dict, k: int):
        self.rows, self.ids = (np.frombuffer(one[c], "<i8") for c in ("rows", "ids"))
        self.x = np.frombuffer(one["x"], f"<i{one['x_bytes']}").reshape(len(self.rows), one["width"])
        self.k, self.floor = k, np.full(len(self.rows), -np.inf)
        self.best = [np.zeros(0, np.int64)] * 3  # query, vector id, score

    def meet(self, rows: np.ndarray, ids: np.ndarray, width: int, index: dict[str, np.ndarray]) -> None:
        who, which, score, _ = best_of_pair(rows, ids, width, index, self.rows, self.x, self.k, self.floor)
        who, ids, score = (np.concatenate(x) for x in zip(self.best, (who, ids[which], score), strict=True))
        order = np.lexsort((ids, -score, who))
        place = np.arange(len(who)) - np.searchsorted(who[order], who[order])
        take = order[place < self.k]
        self.best = [who[take], ids[take], score[take]]
        last = order[place == self.k - 1]
        self.floor[who[last]] = score[last]

    def result(self) -> pa.RecordBatch:
        who, ids, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rows[who], self.ids[who], ids, score)], ["q_row", "query_id", "vec_id", "score"])


def _search(k: int):
    """Rows by cell, in each the queries before the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for one in batch.to_pylist():
                if one["cell"] != cell:
                    yield from (h.result() for h in held)
                    cell, held = one["cell"], []
                if not one["is_index"]:
                    held.append(_Held(one, k))
                    continue
                rows, ids = (np.frombuffer(one[c], "<i8") for c in ("rows", "ids"))
                index = {c: np.frombuffer(one[c], kind) for c, kind in _KINDS.items()} | {"post_value": np.frombuffer(one["x"], f"<i{one['x_bytes']}")}
                for h in held:
                    h.meet(rows, ids, one["width"], index)
        yield from (h.result() for h in held)

    return run


def grid(n_blocks: int, n_query_blocks: int, vector_bytes: int, query_bytes: int, least: int) -> tuple[int, int]:
    """Strips and slots of at least so many cells, if there are so many pairs, that copy the fewest bytes."""
    cells = max(least, -(-n_blocks * n_query_blocks // PAIRS))
    fewest = -(-n_query_blocks // SLOT_BLOCKS)
    shapes = [(max(1, min(n_blocks, -(-cells // slots))), slots) for slots in range(fewest, n_query_blocks + 1)]
    most = max(a * b for a, b in shapes)
    return min((x for x in shapes if x[0] * x[1] >= min(cells, most)), key=lambda x: x[0] * query_bytes + x[1] * vector_bytes)


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    with Scratch(spark, "top-k") as scratch:
        table = scratch.table(scaled_vectors(vectors, scale, id_col, vector_col), "vectors")
        is_query = F.col("vec_id") % every == 0
        cells = F.size("x").cast("long")
        n, c, nq, cq = (x or 0 for x in table.agg(F.count("*"), F.sum(cells), F.count(F.when(is_query, 1)), F.sum(F.when(is_query, cells))).first())
        n_blocks, n_query_blocks = max(1, -(-n // VECTORS), -(-c // VECTOR_CELLS)), max(1, -(-nq // QUERIES), -(-cq // QUERY_CELLS))
        # a query takes its k best to every strip as well
        strips, slots = grid(n_blocks, n_query_blocks, 4 * c + 16 * n, cq + 16 * nq * (1 + k), 8 * spark.sparkContext.defaultParallelism)

        def lists(rows: DataFrame, blocks: int) -> DataFrame:
            block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
            packed = rows.select(block, "row", "vec_id", "x").groupBy("block").agg(F.collect_list(F.struct("row", "vec_id", "x")).alias("rows"))
            return packed.select("block", F.col("rows.row").alias("row"), F.col("rows.vec_id").alias("vec_id"), F.col("rows.x").alias("x"))

        index = scratch.table(lists(table, n_blocks).mapInArrow(_blocks(True), _BLOCK), "index")
        queries = scratch.table(lists(table.where(is_query), n_query_blocks).mapInArrow(_blocks(False), _BLOCK), "queries")
        to_slots = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.pmod("block", F.lit(strips)) * slots + i)
        to_strips = F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda i: i * slots + F.pmod("block", F.lit(slots)))
        dealt = index.withColumn("cell", F.explode(to_slots)).unionByName(queries.withColumn("cell", F.explode(to_strips)))
        # a number of partitions of its own: the work follows the cells, not their bytes
        dealt = dealt.repartition(strips * slots, "cell").sortWithinPartitions("cell", "is_index")
        found = dealt.mapInArrow(_search(k), "q_row long, query_id long, vec_id long, score long")
        order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scratch.keep(best.select("query_id", "rank", "vec_id", "score"))
