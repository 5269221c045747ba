"""Byte-level BPE encoding and decoding with a public vocabulary file.

Texts up to ``leaf`` characters are encoded where they are read. Longer ones go by tree
concatenation: they are cut into leaves, the leaves are spread over the tasks and encoded in
parallel, and the leaves of a text are then joined in pairs, level by level. At each join a window
around the cut is encoded anew and grows until both sides agree with it:

* pieces: the window begins and ends at ends of pre-tokens that both sides' own encodings share with
  it and that no character beyond the window can change. Scanning for pre-tokens depends on the
  position alone, so everything before and after is as in the whole text;
* tokens: inside one long unsplit pre-token, the window shares a token (same place, same id) with
  the left encoding and one with the right. A token sequence is the BPE encoding of its text exactly
  if each neighbouring pair is; all pairs of the joined sequence lie in the left encoding, in the
  window or in the right encoding;
* otherwise the window ends up as the whole of both sides, which is the plain encoding.

A joined text stays a list of parts, and a join reads a window on both sides of its cut, not the texts.

Defined cases: a null or empty text has no ids and decodes to an empty text; the special token's
string in a text becomes its id, and no window crosses it; equal rows each give a row; rows without
a doc_id are encoded too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

# Fixed values of the public byte-level scheme, for texts in the Latin blocks up to U+024F:
# letters, numbers and white space as Unicode has them there, and the scheme's contractions.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = " \\t-\\r\\x85\\xa0"
_LATIN_PIECES = re.compile(
    f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BEYOND_LATIN = re.compile("[^\\x00-ɏ]")
#: Bytes of the memo of pre-tokens, about, and of an entry besides its own text and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 170
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64
#: A piece's end can depend on this many characters after it (a contraction has three).
LOOKAHEAD = 3
#: So many ends of pre-tokens at a leaf's end go with it to its join.
TAIL = 64


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbol that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo:
    """Remembers what some function gives for short texts, in bounded bytes and two generations.

    When half of the bytes are used, what the last half didn't ask for is dropped.
    """

    def __init__(self, function: Callable[[list[str]], list[bytes]]):
        self.function = function
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        young, missing, long = self.young, [], {}
        for t in set(texts):
            if t not in young:
                if (found := self.old.get(t)) is None:
                    missing.append(t)
                else:
                    self._put(t, found)
        for t, found in zip(missing, self.function(missing) if missing else [], strict=True):
            if len(t) > MEMO_CHARS:
                long[t] = found
            else:
                self._put(t, found)
        out = [long[t] if t in long else young[t] for t in texts] if long else list(map(young.__getitem__, texts))
        if self.used > MEMO_BYTES // 2:
            self.old, self.young, self.used = young, {}, 0
        return out

    def _put(self, text: str, found: bytes) -> None:
        self.young[text] = found
        self.used += len(text) + len(found) + ENTRY_BYTES


# Fixed value: how the public byte-level scheme splits a text before its merges.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of this length goes to the tokenizers library; the other one's expressions don't bear much more.
BLANKS = 1 << 16
_BLANKS = re.compile(f"\\s{{{BLANKS}}}")


class Ranks:
    """Whole texts to ids for vocabularies whose ids are in the order of their merges.

    Then ids are ranks, and a merge that makes a token's bytes is the token's own: what lies inside it has been merged as in
    the token alone. Every byte has a token, so the tokens of a text give its bytes back. special: whether the special
    tokens' strings are tokens; else they are plain text.
    """

    def __init__(self, path: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        byte, own = _byte_of_symbol(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in own}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        if not plain or not {bytes([i]) for i in range(256)} <= set(vocab) or any(model["vocab"][x] >= model["vocab"][y] for x, y in pairwise(made)):
            raise ValueError(f"not a plain byte-level BPE vocabulary with ids in the order of merges: {path}")
        self.bytes = [b""] * (max([*vocab.values(), *own.values()]) + 1)
        for t, i in (vocab | {t.encode(): i for t, i in own.items()}).items():
            self.bytes[i] = t
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.encoding = tiktoken.Encoding("ordered", pat_str=_PIECES, mergeable_ranks=vocab, special_tokens=own if special else {})
        self.path, self.special = path, special

    @cached_property
    def library(self):
        """The other library's tokenizer, a second copy of the vocabulary in memory: only texts with very long blanks need it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = not self.special
        return tokenizer

    def encode(self, text: str) -> list[int]:
        if len(text) >= BLANKS and _BLANKS.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoding.encode(text, allowed_special="all") if self.special else self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))


class Codec:
    """One vocabulary, with a bounded memo from pre-tokens to ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = _byte_of_symbol()
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(byte[c] for c in token) if token not in self.special else b""
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.memo = Memo(self._encoded)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _BEYOND_LATIN.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _LATIN_PIECES.findall(text)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split_special is not None and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special else self.encode(p) for p in parts if p)
        if not text.isascii() and _BEYOND_LATIN.search(text):
            return self._plain(text).astype("<u4").tobytes()
        return b"".join(self.memo(_LATIN_PIECES.findall(text)))

    def count(self, text: str) -> int:
        """How many ids encode(text) has."""
        return len(self.encode(text)) // 4

    def forget(self) -> None:
        """Give the memo's memory back; Python workers live on after their task."""
        self.memo.forget()

    def decode(self, ids: bytes) -> str:
        """As the library does, with special tokens kept; bytes that are no text become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    # joins

    def _marks(self, text: str) -> np.ndarray:
        """Ends of pre-tokens."""
        return np.cumsum([len(p) for p in self.pieces(text)], dtype=np.int64)

    def head_marks(self, x: Encoded, upto: int) -> np.ndarray:
        """Ends of pre-tokens in the first ``upto`` characters. Only those are scanned, and as many again."""
        if x.marks is None and 2 * (upto + LOOKAHEAD) < len(x.text):
            marks = self._marks(x.text[: 2 * upto + LOOKAHEAD])[:-1]  # the last piece may go on
            if len(marks) and marks[-1] >= upto + LOOKAHEAD:
                return marks[marks <= upto]
        return (m := self._all_marks(x))[m <= upto]

    def tail_marks(self, x: Encoded, start: int) -> np.ndarray:
        """Ends of pre-tokens from ``start`` on, as far as the end of the text doesn't change them."""
        marks = x.tail if x.tail is not None and len(x.tail) and x.tail[0] <= start else self._all_marks(x)
        return marks[(marks >= start) & (marks <= len(x.text) - LOOKAHEAD)]

    def _all_marks(self, x: Encoded) -> np.ndarray:
        if x.marks is None:
            x.marks = self._marks(x.text)
        return x.marks

    def _without_tail(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        """ids without the tokens of the last n_bytes; only those are looked at."""
        some = ids[max(0, len(ids) - n_bytes) :]
        gone = int(np.searchsorted(np.cumsum(self.sizes[some[::-1]]), n_bytes, side="left")) + 1 if n_bytes else 0
        return ids[: len(ids) - gone]

    def _without_head(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        gone = int(np.searchsorted(np.cumsum(self.sizes[ids[:n_bytes]]), n_bytes, side="left")) + 1 if n_bytes else 0
        return ids[gone:]

    def join(self, left: Encoded, right: Encoded, window: int = 32) -> tuple[Encoded, Encoded] | None:
        """Both texts encoded as one, cut anew where the encoding allows it; None if no window inside them agrees."""
        cut = len(left.text)
        while window < cut or window < len(right.text):
            a, b = max(0, cut - window), min(len(right.text), window)
            found = self._by_pieces(left, right, a, b) or self._by_tokens(left, right, a, b)
            if found is not None:
                return found
            window *= 4
        return None

    def _by_pieces(self, left: Encoded, right: Encoded, a: int, b: int) -> tuple[Encoded, Encoded] | None:
        """The window begins at an end of a pre-token of the left and ends at one of the right that its own scan has too."""
        cut = len(left.text)
        safe = self.tail_marks(left, a)
        if not len(safe):
            return None
        start = int(safe[0])
        text = left.text[start:] + right.text[:b]
        scan = self._marks(text)[:-1] - (cut - start)  # in characters of the right; the last piece may go on
        stops = scan[(scan >= 0) & (scan <= b - LOOKAHEAD)]
        stops = stops[np.isin(stops, self.head_marks(right, b))]
        if not len(stops):
            return None
        stop = int(stops[0])
        middle = np.frombuffer(self.encode(left.text[start:] + right.text[:stop]), "<u4")
        head = self._without_tail(left.ids, len(left.text[start:].encode()))
        tail = self._without_head(right.ids, len(right.text[:stop].encode()))
        ends = np.concatenate([safe[safe <= start], scan[(scan + cut > start) & (scan <= stop)] + cut])
        rest = right.tail - stop if right.tail is not None else None
        return Encoded(left.text + right.text[:stop], np.concatenate([head, middle]), tail=ends), Encoded(right.text[stop:], tail, tail=rest[rest >= 0] if rest is not None else None)

    def _by_tokens(self, left: Encoded, right: Encoded, a: int, b: int) -> tuple[Encoded, Encoded] | None:
        """Only where one pre-token runs through the whole window and beyond it on both sides.

        The cut comes after a token that the left encoding and the window share, at an end of a character.
        """
        cut = len(left.text)
        if a < LOOKAHEAD or b + LOOKAHEAD > len(right.text):
            return None
        around = left.text[a - LOOKAHEAD :] + right.text[: b + LOOKAHEAD]
        text = around[LOOKAHEAD:-LOOKAHEAD]
        if len(self.pieces(around)) != 1 or len(self.pieces(text)) != 1:
            return None
        ids = self._plain(text)
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        of_char = np.cumsum([len(c.encode()) for c in text])
        middle, after = int(of_char[cut - a - 1]), int(of_char[-1])
        l_some = left.ids[max(0, len(left.ids) - middle) :]
        l_ends = middle - np.concatenate([[0], np.cumsum(self.sizes[l_some[::-1]])[:-1]])[::-1]
        r_some = right.ids[: after - middle]
        r_ends = np.cumsum(self.sizes[r_some]) + middle
        on_left, on_right = dict(zip(l_ends.tolist(), l_some.tolist(), strict=True)), dict(zip(r_ends.tolist(), r_some.tolist(), strict=True))
        firsts = [k for k in range(len(ids)) if ends[k] <= middle and on_left.get(int(ends[k])) == ids[k] and ends[k] in of_char]
        lasts = [k for k in range(len(ids)) if begins[k] >= middle and on_right.get(int(ends[k])) == ids[k]]
        if not firsts or not lasts:
            return None
        i, j = firsts[-1], lasts[0]
        at = a + int(np.searchsorted(of_char, ends[i])) + 1
        head = self._without_tail(left.ids, middle - int(ends[i]))
        tail = np.concatenate([ids[i + 1 : j], self._without_head(right.ids, int(begins[j]) - middle)])
        rest = right.tail + (cut - at) if right.tail is not None else None
        return Encoded(left.text[:at], head), Encoded(left.text[at:] + right.text, tail, tail=rest)

    def tree(self, leaves: list[Encoded]) -> np.ndarray:
        """The ids of all leaves together: neighbours are joined in pairs, level by level.

        A joined text stays a list of parts, and a join looks at the two parts at its cut only; while
        no window inside them agrees, they are put together with the parts beside them.
        """
        ropes = [[leaf] for leaf in leaves]
        while len(ropes) > 1:
            ropes = [self._roped(ropes[i], ropes[i + 1]) if i + 1 < len(ropes) else ropes[i] for i in range(0, len(ropes), 2)]
        return np.concatenate([x.ids for x in ropes[0]])

    def _roped(self, left: list[Encoded], right: list[Encoded]) -> list[Encoded]:
        x, y = left[-1], right[0]
        before, after = left[:-1], right[1:]
        while (found := self.join(x, y)) is None:
            if not before and not after:
                text = x.text + y.text
                return [Encoded(text, np.frombuffer(self.encode(text), "<u4"))]
            if before:
                p = before.pop()
                x = Encoded(p.text + x.text, np.concatenate([p.ids, x.ids]))
            if after:
                p = after.pop(0)
                y = Encoded(y.text + p.text, np.concatenate([y.ids, p.ids]))
        return [*before, *(f for f in found if f.text), *after]


class Encoded:
    """A text and its ids; ``tail``: the last ends of its pre-tokens, ``marks``: all of them once needed (characters)."""

    def __init__(self, text: str, ids: np.ndarray, tail: np.ndarray | None = None):
        self.text, self.ids, self.tail = text, ids, tail
        self.marks: np.ndarray | None = None


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a Python worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


_RANKS: dict[tuple[str, bool], Ranks] = {}


def ranks(path: str, special: bool = True) -> Ranks:
    """One for each Python worker and vocabulary."""
    if (path, special) not in _RANKS:
        _RANKS[path, special] = Ranks(path, special)
    return _RANKS[path, special]


def _row(c: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _table(ids: pd.Series, rows: list[tuple[int, str, str]]) -> pd.DataFrame:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"doc_id": ids.astype("Int64").to_numpy(), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}).astype({"doc_id": "Int64", "n_tokens": "int64"})


def bpe_round_trip(docs: DataFrame, vocabulary: str, leaf: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row."""
    texts = documents(docs, id_col, text_col)

    def short(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for part in parts:
            yield _table(part["doc_id"], [_row(c, c.encode(t)) for t in part["text"]])
        c.forget()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each leaf; a special token's string is a leaf of its own kind."""
        c = codec(vocabulary)
        for part in parts:
            for key, doc, text in zip(part["key"], part["doc_id"], part["text"], strict=True):
                out, segment = [], 0
                for piece in c.split_special.split(text) if c.split_special is not None else [text]:
                    if piece:
                        step = len(piece) if piece in c.special else leaf
                        out += [(segment, piece[i : i + step]) for i in range(0, len(piece), step)]
                        segment += 1
                yield pd.DataFrame({"key": key, "doc_id": pd.array([doc] * len(out), "Int64"), "at": range(len(out)), "segment": [s for s, _ in out], "leaf": [t for _, t in out]})

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for part in parts:
            # the ends of a leaf's last pre-tokens; a special token has none
            tails = [c._marks(t)[-TAIL:].tolist() if t not in c.special else [] for t in part["leaf"]]
            yield part.assign(doc_id=part["doc_id"].astype("Int64"), ids=[c.encode(t) for t in part["leaf"]], tail=tails)
        c.forget()

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(vocabulary)
        group = group.sort_values("at")
        ids = b"".join(
            c.tree([Encoded(t, np.frombuffer(i, "<u4"), np.asarray(m, np.int64)) for t, i, m in zip(s["leaf"], s["ids"], s["tail"], strict=True)]).astype("<u4").tobytes()
            for _, s in group.groupby("segment", sort=True)
        )
        return _table(group["doc_id"].iloc[:1], [_row(c, ids)])

    whole = texts.where(F.length("text") <= leaf).mapInPandas(short, _RESULT)
    leaves = texts.where(F.length("text") > leaf).withColumn("key", F.monotonically_increasing_id()).mapInPandas(cut, "key long, doc_id long, at int, segment int, leaf string")
    encoded = leaves.repartition("key", "at").mapInPandas(encode, "key long, doc_id long, at int, segment int, leaf string, ids binary, tail array<long>")
    return whole.unionByName(encoded.groupBy("key").applyInPandas(joined, _RESULT))
