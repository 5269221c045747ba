"""A byte-level BPE tokenizer as a deterministic transducer whose moves carry token counts.

Splitting into pre-tokens looks at a few neighbouring characters only, so all of a batch's splits are
found at once on arrays. Each pre-token then starts the transducer anew, which reads its bytes.

Let n(i) be the number of tokens of a pre-token's first i bytes. Every run of neighbouring tokens
of an encoding is the encoding of its own bytes, so the last token of the first i bytes is the one token
t ending there for which (last token before t, t) is a pair that no merge crosses. To know the next one
it is enough to have, for each start p from which the bytes since p begin some token: the trie node of
those bytes, the last token of the first p bytes, and n(p) - n(i). Those triples are the state. A
move reads one byte and emits n(i + 1) - n(i), which may be negative; the sum over a pre-token is its
number of tokens.

States and moves are compiled when a text first needs them (all of them would be too many) and kept in
a hash table of bounded size. A state's bytes mean the same in every process, so maps between states can
be handed from task to task.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .bpe import _byte_of_symbol

#: Classes of characters: letters, numbers, others, the space, other white space, none (beyond a text's ends).
LETTER, NUMBER, OTHER, SPACE, WHITE, NONE = range(6)
_UNKNOWN = 255
#: Compiled states kept at most; then they are forgotten and compiled anew when needed.
STATES = 300_000
#: Bytes of a lane: so many lanes as there are, so many bytes are read at a time.
LANE = 512
#: With fewer lanes left, bytes are read one by one.
FEW = 24
#: Whether a character begins a pre-token depends on so many characters before it.
LOOKBEHIND = 4
START = array("i", [0, -1, 0]).tobytes()



class Transducer:
    """Compiled from a tokenizers file with byte-level BPE; other kinds are refused."""

    def __init__(self, path: str, states: int = STATES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pre_tokenize = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.limit = states
        self._classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._merges(model)
        self._forget()

    def _merges(self, model: dict) -> None:
        """Trie of the tokens that merges can make, the pair and the rank that make each."""
        byte, vocab = _byte_of_symbol(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        if len(self.parts) != len(pairs):
            raise ValueError("a token that two merges make")
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self._fit: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for text, token in vocab.items():
            if token in self.parts or len(text) == 1:
                if token in self.parts and not self._makes(token):
                    continue
                node = 0
                for symbol in text:
                    key = node << 8 | byte[symbol]
                    self.inner[node] = True
                    if (following := self.child.get(key)) is None:
                        following = self.child[key] = len(self.token_at)
                        self.token_at.append(-1)
                        self.inner.append(False)
                    node = following
                self.token_at[node] = token

    def _crossing(self, left: int, right: int) -> int | None:
        """The rank of the first merge that joins the end of one token to the beginning of the next, if any.

        Both tokens are taken apart, what was made last first. Two parts lie side by side from when the later
        one is made until the first of them is merged into a larger part of its own token. Of equal merges the
        leftmost comes first: the left token's own before the crossing one, and that before the right token's own.
        """
        until_left = until_right = 1 << 62
        found = None
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < until_left and r <= until_right:
                found = r
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                return found
            if made_left > made_right:
                until_left, left = made_left, self.parts[left][1]
            else:
                until_right, right = made_right, self.parts[right][0]

    def _makes(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token: no earlier merge crosses the parts of any of its parts."""
        stack = [token]
        while stack:
            if (p := self.parts.get(t := stack.pop())) is not None:
                if self._crossing(*p) != self.rank[p]:
                    return False
                stack += p
        return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 24 | right
        if (known := self._fit.get(key)) is None:
            if len(self._fit) >= self.limit:
                self._fit.clear()
            known = self._fit[key] = self._crossing(left, right) is None
        return known

    # states

    def _forget(self) -> None:
        self.number = {START: 0}
        self.state = [START]
        self._room(1 << 16)

    def _room(self, size: int) -> None:
        old = getattr(self, "table", None) if len(self.state) > 1 else None
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.table = np.full((size, 2), -1, np.int64)
        self.filled = 0
        if old is not None:
            for key, value in old[old[:, 0] >= 0].tolist():
                self._put(key, value)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, key: int, value: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.table[at, 0] >= 0:
            at = (at + 1) & self.mask
        self.table[at] = key, value
        self.filled += 1

    def intern(self, state: bytes) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.state)
            self.state.append(state)
        return n

    def _move(self, state: bytes, byte: int) -> tuple[bytes, int]:
        """The state after one more byte, and by how much the number of tokens grows."""
        flat = array("i")
        flat.frombytes(state)
        child, alive, token, gain = self.child, array("i"), -1, 0
        for i in range(0, len(flat), 3):
            node = child.get(flat[i] << 8 | byte)
            if node is not None:
                t = self.token_at[node]
                if token < 0 <= t and (flat[i + 1] < 0 or self._fits(flat[i + 1], t)):
                    token, gain = t, flat[i + 2] + 1
                if self.inner[node]:
                    alive.extend((node, flat[i + 1], flat[i + 2]))
        for i in range(2, len(alive), 3):
            alive[i] -= gain
        alive.extend((0, token, 0))
        return alive.tobytes(), gain

    def _compile(self, key: int) -> int:
        """The move of a new key (state and byte), as it stands in the table."""
        after, gain = self._move(self.state[key >> 8], key & 255)
        value = self.intern(after) << 8 | gain + 128
        if 2 * (self.filled + 1) > len(self.table):
            self._room(2 * len(self.table))
        self._put(key, value)
        return value

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; moves not yet compiled are."""
        at = self._slot(keys)
        got = self.table[at]
        value = got[:, 1]
        open_ = np.flatnonzero(got[:, 0] != keys)
        missing = []
        while len(open_):
            empty = self.table[at[open_], 0] < 0
            if empty.any():
                missing.append(open_[empty])
                open_ = open_[~empty]
            at[open_] = (at[open_] + 1) & self.mask
            got = self.table[at[open_]]
            hit = got[:, 0] == keys[open_]
            value[open_[hit]] = got[hit, 1]
            open_ = open_[~hit]
        if missing:
            rows = np.concatenate(missing)
            new, which = np.unique(keys[rows], return_inverse=True)
            value[rows] = np.array([self._compile(k) for k in new.tolist()], np.int64)[which]
        return value

    def one(self, key: int) -> int:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (k := int(self.table[at, 0])) != key:
            if k < 0:
                return self._compile(key)
            at = (at + 1) & self.mask
        return int(self.table[at, 1])

    def run(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte what it adds to the number of tokens, and the state (its number) after it.

        begins: where pre-tokens begin, the first byte among them. Lanes of about LANE bytes that begin with a
        pre-token are read side by side. Numbers of states are good until the next call.
        """
        gain, after = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        if len(self.state) > self.limit:
            self._forget()
        if not len(data):
            return gain, after
        at = np.searchsorted(begins, np.arange(0, len(data), LANE))
        starts = np.unique(begins[at[at < len(begins)]])
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        first = np.zeros(len(data), bool)
        first[begins] = True
        still = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # lanes with more than t bytes
        state = np.zeros(len(starts), np.int64)
        t = 0
        while t < sizes[0] and still[t] >= FEW:
            p = starts[: still[t]] + t
            state = np.where(first[p], 0, state[: len(p)])
            value = self._look(state << 8 | data[p])
            state = value >> 8
            gain[p] = (value & 255) - 128
            after[p] = state
            t += 1
            if len(self.state) > 2 * self.limit:
                kept = [self.state[s] for s in state.tolist()]
                self._forget()
                state = np.array([self.intern(s) for s in kept], np.int64)
                after[:] = -1  # numbers from before are void
                after[p] = state
        if t < sizes[0]:
            for lane in range(still[t]):
                a, b = int(starts[lane]) + t, int(starts[lane] + sizes[lane])
                s, known = int(state[lane]), {}
                for p, (byte, anew) in enumerate(zip(data[a:b].tolist(), first[a:b].tolist(), strict=True), a):
                    key = (0 if anew else s) << 8 | byte
                    if (v := known.get(key)) is None:
                        v = known[key] = self.one(key)
                    s = v >> 8
                    gain[p] = (v & 255) - 128
                    after[p] = s
        return gain, after

    def follow(self, state: bytes, data: bytes) -> tuple[int, bytes]:
        """Tokens gained, and the state, after the bytes of one unfinished pre-token."""
        s, total, known = self.intern(state), 0, {}
        for byte in data:
            key = s << 8 | byte
            if (v := known.get(key)) is None:
                v = known[key] = self.one(key)
            s = v >> 8
            total += (v & 255) - 128
        return total, self.state[s]

    # pre-tokens

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points; those met for the first time are asked of the library's own splitter."""
        out = self._classes[points]
        if (out == _UNKNOWN).any():
            for c in np.unique(points[out == _UNKNOWN]).tolist():
                one = chr(c)
                kind = next((k for k, with_ in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.pre_tokenize(with_ + one)) == 1), SPACE if one == " " else WHITE)
                self._classes[c] = kind
            out = self._classes[points]
        return out

    def begins(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which code points begin a pre-token; first: those that begin a text."""
        if not len(points):
            return np.zeros(0, bool)
        kind = self.classes(points)
        before = np.concatenate([[NONE], kind[:-1]])
        before[first] = NONE
        after = np.concatenate([kind[1:], [NONE]])
        after[:-1][first[1:]] = NONE
        white, white_before = (kind == SPACE) | (kind == WHITE), (before == SPACE) | (before == WHITE)
        # words, numbers and others take one space before them; of white space before a word the last one is cut off
        out = first | (~white & (before != kind) & (before != SPACE)) | (white & ~white_before) | (white & white_before & (after <= OTHER))
        short = np.flatnonzero((points == ord("'")) & out)
        if len(short):
            text_end = np.append(np.flatnonzero(first), len(points))
            end = text_end[np.searchsorted(text_end, short, side="right")]
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[short + 1], padded[short + 2]
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]) & (short + 1 < end), 2, np.where(pair & (short + 2 < end), 3, 0))
            short, size, end = short[size > 0], size[size > 0], end[size > 0]
            out[short + 1] = False
            stop = short + size
            stop = stop[stop < end]
            out[stop[kind[stop] == LETTER]] = True
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, where pre-tokens begin, and where each text begins (one more at the end)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        first = np.zeros(len(points), bool)
        starts = ends - [len(t) for t in texts]
        first[starts[starts < ends]] = True
        size = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(size)])
        return np.frombuffer(joined.encode(), np.uint8), offset[:-1][self.begins(points, first)], offset[np.append(starts, len(points))]


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker and vocabulary."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]
