"""Token counts by a compiled tokenizer: a deterministic transducer whose moves carry token counts.

Texts up to ``chunk`` characters are counted where they are read. Longer ones are cut into chunks that are
spread over the tasks. Each chunk becomes a map from the state in which it is entered to the state in
which it is left and the tokens it adds:

* a pre-token that begins in the chunk, or not far before it, starts the transducer anew whatever came before,
  so what follows is the same for every state;
* only inside one long unsplit pre-token the map depends on the state. It then holds the states that
  follow from starting at each of the last characters before the chunk; states soon fall together, and
  texts that repeat themselves have few.

The maps of a text are composed in pairs, level by level. If a composition needs a state that a map doesn't
hold, that state is followed through the chunk's unsplit head, which goes with the map. So the count is exact.

Defined cases: a null or empty text has no bytes and no tokens; a special token's string counts as one token,
as the library has it; equal rows each give a row; rows without a doc_id are counted too; other columns are
ignored. A text's maps are composed in one task: a few bytes a chunk, and the heads of unsplit pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .transducer import LOOKBEHIND, START, Transducer, transducer

#: Characters that are counted at a time.
SLICE = 1 << 20
#: Characters before a chunk that go with it; states are tried from the last of them.
BEFORE, TRIED = 256, 48
_RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_MAPS = "key long, doc_id long, at int, n_bytes long, plain long, left binary, head binary, entered array<binary>, exits array<binary>, gains array<long>"
_KINDS = {"key": pa.int64(), "doc_id": pa.int64(), "at": pa.int32(), "n_bytes": pa.int64(), "plain": pa.int64(), "left": pa.binary(), "head": pa.binary(), "entered": pa.list_(pa.binary()), "exits": pa.list_(pa.binary()), "gains": pa.list_(pa.int64())}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _special(t: Transducer) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(t.special, key=len, reverse=True))) + ")") if t.special else None


def count_tokens(t: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text, special tokens' strings as one each."""
    special = _special(t)
    out = np.zeros(len(texts), np.int64)
    for lo, hi in _slices(texts):
        parts, owner = [], []
        for i in range(lo, hi):
            if special is not None and any(s in texts[i] for s in t.special):
                cut = special.split(texts[i])
                out[i] += len(cut) // 2
                parts += cut[::2]
                owner += [i] * len(cut[::2])
            else:
                parts.append(texts[i])
                owner.append(i)
        data, begins, at = t.split(parts)
        total = np.concatenate([[0], np.cumsum(t.run(data, begins)[0])])
        np.add.at(out, np.array(owner, np.int64), total[at[1:]] - total[at[:-1]])
    return out


class StateMap:
    """What a stretch of text does to a state: the state in which it is left, and the tokens it adds.

    fixed: the same for every state, or None. Else ``known`` has the states met so far, and more are found when asked.
    """

    def __init__(self, fixed: tuple[int, bytes] | None, known: dict[bytes, tuple[int, bytes]], more=None):
        self.fixed, self.known, self._more = fixed, known, more

    def __call__(self, state: bytes) -> tuple[int, bytes]:
        if self.fixed is not None:
            return self.fixed
        if state not in self.known:
            self.known[state] = self._more(state)
        return self.known[state]

    def then(self, other: StateMap) -> StateMap:
        """This stretch and the one after it as one."""

        def both(result: tuple[int, bytes]) -> tuple[int, bytes]:
            n, state = other(result[1])
            return result[0] + n, state

        if self.fixed is not None:
            return StateMap(both(self.fixed), {})
        return StateMap(None, {s: both(r) for s, r in self.known.items()}, lambda s: both(self(s)))


def composed(maps: list[StateMap]) -> StateMap:
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def chunk_maps(t: Transducer, part: pd.DataFrame, tried: int = TRIED) -> list[tuple]:
    """Rows (key, doc_id, at, before, chunk, after) as rows of _MAPS.

    plain: tokens of the bytes that count the same for every state; left: the state after them, empty if the
    chunk has no such bytes; head: the bytes before them, which end a long pre-token.
    """
    whole = [b + c + a for b, c, a in zip(part["before"], part["chunk"], part["after"], strict=True)]
    rows = []
    for lo, hi in _slices(whole):
        points = np.frombuffer("".join(whole[lo:hi]).encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in whole[lo:hi]])])
        first = np.zeros(len(points), bool)
        first[starts[:-1]] = True
        begins = t.begins(points, first)
        todo, pieces = [], []
        for i in range(lo, hi):
            before, chunk = part["before"].iat[i], part["chunk"].iat[i]
            own = begins[starts[i - lo] : starts[i - lo] + len(before) + len(chunk)]
            if len(before) == BEFORE:
                own[:LOOKBEHIND] = False  # what came before them isn't here
            cut = np.flatnonzero(own)
            earlier = cut[cut <= len(before)]
            at = int(earlier[-1]) if len(earlier) else int(cut[0]) if len(cut) else len(own)
            text = (before + chunk)[at:]
            size = np.fromiter((len(c.encode()) for c in text), np.int64, len(text)) if not text.isascii() else np.ones(len(text), np.int64)
            offset = np.concatenate([[0], np.cumsum(size)])
            pieces.append((text.encode(), offset[:-1][own[at:]]))
            todo.append((i, before, chunk, at))
        base = np.concatenate([[0], np.cumsum([len(b) for b, _ in pieces])])
        data = np.frombuffer(b"".join(b for b, _ in pieces), np.uint8)
        gain, after = t.run(data, np.concatenate([s + b for (_, s), b in zip(pieces, base, strict=False)]) if len(data) else np.zeros(0, np.int64))
        total = np.concatenate([[0], np.cumsum(gain)])
        lefts = [t.state[after[base[k + 1] - 1]] if base[k + 1] > base[k] else b"" for k in range(len(pieces))]
        for k, (i, before, chunk, at) in enumerate(todo):
            skip = len((before + chunk)[at : len(before)].encode()) if at < len(before) else 0
            plain = int(total[base[k + 1]] - total[base[k] + skip])
            head = (before + chunk)[len(before) : at].encode() if at > len(before) else b""
            found: dict[bytes, tuple[int, bytes]] = {}
            if head:
                for back in range(1, min(tried, len(before)) + 1):
                    entry = t.follow(START, before[-back:].encode())[1]
                    if entry not in found:
                        found[entry] = t.follow(entry, head)
            rows.append((part["key"].iat[i], part["doc_id"].iat[i], part["at"].iat[i], len(chunk.encode()), plain, lefts[k], head, list(found), [x for _, x in found.values()], [n for n, _ in found.values()]))
    return rows


def _state_map(t: Transducer, plain: int, left: bytes, head: bytes, entered, exits, gains) -> StateMap:
    if not head:
        return StateMap((plain, left), {})
    after = lambda n, state: (n + plain, left or state)
    return StateMap(None, {bytes(e): after(int(n), bytes(x)) for e, x, n in zip(entered, exits, gains, strict=True)}, lambda s: after(*t.follow(s, head)))


def _counted(rows: list[tuple[int | None, int, int]], limit: int) -> pa.RecordBatch:
    doc, size, n = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = 16_384, tried: int = TRIED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row."""
    texts = documents(docs, id_col, text_col)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            own = batch.column(1).to_pylist()
            yield _counted(list(zip(batch.column(0).to_pylist(), [len(x.encode()) for x in own], count_tokens(t, own).tolist(), strict=True)), limit)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each chunk; a special token's string is a chunk of its own, and nothing beyond it counts as before or after."""
        special = _special(transducer(vocabulary))
        for part in parts:
            for key, doc, text in zip(part["key"], part["doc_id"], part["text"], strict=True):
                rows = []
                for n, piece in enumerate(special.split(text) if special is not None else [text]):
                    step = chunk if n % 2 == 0 else len(piece)
                    rows += [(piece[max(0, i - BEFORE) : i], piece[i : i + step], piece[i + step : i + step + LOOKBEHIND], n % 2 == 1) for i in range(0, len(piece), step or 1)]
                before, own, after, is_special = zip(*rows, strict=True)
                yield pd.DataFrame({"key": key, "doc_id": pd.array([doc] * len(rows), "Int64"), "at": range(len(rows)), "before": before, "chunk": own, "after": after, "special": is_special})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            part = pa.Table.from_batches([batch]).to_pandas(integer_object_nulls=True)
            rows = chunk_maps(t, part[~part["special"]], tried)
            rows += [(r.key, r.doc_id, r.at, len(r.chunk.encode()), 1, START, b"", [], [], []) for r in part[part["special"]].itertuples()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS.values(), strict=True)], list(_KINDS))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts from their chunks' maps, which come in order; one text's maps are held at a time."""
        t, key, doc, size, own = transducer(vocabulary), None, None, 0, []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if own:
                        done.append((doc, size, composed(own)(START)[0]))
                    key, doc, size, own = row["key"], row["doc_id"], 0, []
                size += row["n_bytes"]
                own.append(_state_map(t, *(row[c] for c in ("plain", "left", "head", "entered", "exits", "gains"))))
            yield _counted(done, limit)
        if own:
            yield _counted([(doc, size, composed(own)(START)[0])], limit)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = texts.where(F.length("text") <= chunk).mapInArrow(short, _RESULT)
    long = texts.where(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id()).mapInPandas(cut, "key long, doc_id long, at int, before string, chunk string, after string, special boolean")
    return whole.unionByName(long.repartition("key", "at").mapInArrow(maps, _MAPS).repartition(tasks, "key").sortWithinPartitions("key", "at").mapInArrow(joined, _RESULT))
