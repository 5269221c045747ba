"""Personal data: pattern findings, and a character BiLSTM with CRF transitions that adds to them.

Base findings (e-mail, IPv4, card and phone) follow fixed patterns, leftmost and non-overlapping for
each kind, failing matches dropped without another try. The scanners are linear in the text.

The model finds what the patterns can't: addresses that are spelled out (``name at host dot org``,
``name [at] host.org``), addresses with bracketed or spaced dots, card numbers with other separators,
phone numbers without a plus. It is a character-level bidirectional LSTM with a linear-chain CRF over
B/I/O tags, trained in numpy (seeded, on the driver) from labelled spans: windows of at most
``carriers`` documents, those with the smallest hashes, with their base findings and
planted forms as labels. Only that sample is bounded; every text is scanned whole.

Each such form has a digit, an @ or a spelled-out ``dot`` or ``(at)`` in it, so only stretches around those
are read. They are cut into overlapping windows and each window is decoded by Viterbi. The tags are
stitched: each character takes its tag from the window in whose middle it lies, so a span may be longer
than a window. Spans of the stitched tags and of the single windows are reconciled globally: of
overlapping ones the set with the largest total score stays (weighted interval scheduling). A model
span counts if it has the kind's loose form (parts up to 255, Luhn for cards, 9 to 15 digits) and
overlaps no base finding; base findings always stay.

Defined cases: a null text counts as empty and has no spans; equal rows each give a row; rows without
a doc_id are scanned too; an empty table gives no rows (the model is then trained on generated words
alone); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, smallest_hashes

KINDS = ["email", "ip", "card", "phone"]
# Fixed forms of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_BASE_TRIGGER = re.compile("[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|[\[({] ?at ?[\])}]|\bat [a-z0-9-]+\.[a-z]", re.IGNORECASE)

Span = tuple[int, int, int]  # kind, start, end


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """All base findings by kind, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return out


# What a model span must look like: the base kinds, spelled out or with other separators.
_AT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| at )"
_DOT = r"(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot |\.)"
_WELL_FORMED = [
    re.compile(rf"[a-z0-9](?:[a-z0-9_%+-]|{_DOT}(?=[a-z0-9]))*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.IGNORECASE),
    re.compile(rf"[0-9]{{1,3}}(?:(?:{_DOT}| \. )[0-9]{{1,3}}){{3}}", re.IGNORECASE),
    re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9])+"),
    re.compile(r"\+?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ ./-]{1,2}(?:\([0-9]{1,5}\)|[0-9]{2,5})){2,5}"),
]


def _parts_hold(s: str) -> bool:
    return all(int(p) <= 255 for p in re.findall("[0-9]+", s))


_HOLDS = [lambda s: True, _parts_hold, _is_card, _is_phone]


def well_formed(kind: int, s: str) -> bool:
    return bool(_WELL_FORMED[kind].fullmatch(s)) and _HOLDS[kind](s)


# the model

_SYMBOLS = "@.-+_%() :/,;\n#\"'[]{}"
_OUTSIDE, _OTHER = 27, 28 + len(_SYMBOLS)
V = _OTHER + 1
HIDDEN, TAGS, WINDOW, STRIDE = 20, 1 + 2 * len(KINDS), 64, 32


def _classes() -> np.ndarray:
    """Letters without regard to case are 0 to 25, digits 26, then what lies outside a text and the symbols."""
    table = np.full(128, _OTHER)
    for c in range(128):
        s = chr(c).lower()
        table[c] = ord(s) - 97 if "a" <= s <= "z" else 26 if s.isdigit() else 28 + _SYMBOLS.index(s) if s in _SYMBOLS else _OTHER
    return table


_CLASS = _classes()


def encode(text: str) -> np.ndarray:
    """Character classes; letters beyond ASCII are other characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _OTHER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM emissions and CRF transitions; windows come as (batch, time) class numbers."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (V, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.3 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["out"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
        p["bias"] = np.zeros(TAGS)
        p["move"] = np.zeros((TAGS, TAGS))
        return cls(p)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        b, t = x.shape
        kind = self.p["out"].dtype
        h, c = np.zeros((b, HIDDEN), kind), np.zeros((b, HIDDEN), kind)
        states, out = [], np.empty((t, b, HIDDEN), kind)
        for i in range(t):
            z = self.p[f"x{d}"][x[:, i]] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i_, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i_ * g
            tanh = np.tanh(new)
            if keep:
                states.append((x[:, i], h, c, i_, f, o, g, tanh))
            h, c = o * tanh, new
            out[i] = h
        return out, states

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, sf = self._lstm(x, "f", keep)
        backward, sb = self._lstm(x[:, ::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["out"] + self.p["bias"], (both, sf, sb)

    def moves(self) -> np.ndarray:
        """Transitions; an inside tag follows only its own kind."""
        m = self.p["move"].copy()
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            m[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -30
        return m

    def viterbi(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags, and each one's emission above that of O."""
        e, _ = self.emissions(x)
        m = self.moves()
        t, b, _ = e.shape
        start = np.zeros(TAGS)
        start[2::2] = -30
        score, back = e[0] + start, np.empty((t, b, TAGS), np.int8)
        for i in range(1, t):
            total = score[:, :, None] + m
            back[i] = total.argmax(1)
            score = total.max(1) + e[i]
        tags = np.empty((b, t), np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(b)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        e = e.transpose(1, 0, 2)
        return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradient."""
        e, (both, sf, sb) = self.emissions(x, keep=True)
        t, b, _ = e.shape
        m = self.moves()
        start = np.zeros(TAGS)
        start[2::2] = -30
        # forward and backward in scaled probabilities; size[i] is what alpha[i] was divided by
        top = e.max(2, keepdims=True)
        weight, move = np.exp(e - top), np.exp(m)
        alpha, beta, size = np.empty_like(e), np.ones_like(e), np.empty((t, b, 1))
        for i in range(t):
            alpha[i] = weight[i] * (np.exp(start) if i == 0 else alpha[i - 1] @ move)
            size[i] = alpha[i].sum(1, keepdims=True)
            alpha[i] /= size[i]
        for i in range(t - 2, -1, -1):
            beta[i] = (weight[i + 1] * beta[i + 1] / size[i + 1]) @ move.T
        z = (np.log(size) + top).sum((0, 2))
        de = alpha * beta
        dm = move * np.einsum("tbj,tbk->jk", alpha[:-1], weight[1:] * beta[1:] / size[1:])
        rows, yt = np.arange(b), y.T
        gold = start[yt[0]] + e[0][rows, yt[0]]
        for i in range(t):
            de[i][rows, yt[i]] -= 1
            if i:
                gold = gold + m[yt[i - 1], yt[i]] + e[i][rows, yt[i]]
                np.add.at(dm, (yt[i - 1], yt[i]), -1)
        de /= b
        g = {"move": np.where(m > -30, dm / b, 0), "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, de)}
        dh = de @ self.p["out"].T
        self._back(dh[:, :, :HIDDEN], sf, "f", g)
        self._back(dh[::-1, :, HIDDEN:], sb, "b", g)
        return float((z - gold).mean()), g

    def _back(self, dout: np.ndarray, states: list, d: str, g: dict[str, np.ndarray]) -> None:
        wh = self.p[f"h{d}"]
        gx, gh, gc = np.zeros((V, 4 * HIDDEN)), np.zeros_like(wh), np.zeros(4 * HIDDEN)
        dh = np.zeros_like(dout[0])
        dc = np.zeros_like(dout[0])
        for i in range(len(states) - 1, -1, -1):
            x, h, c, i_, f, o, gg, tanh = states[i]
            dh = dh + dout[i]
            dc = dc + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * gg * i_ * (1 - i_), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i_ * (1 - gg**2)], 1)
            np.add.at(gx, x, dz)
            gh += h.T @ dz
            gc += dz.sum(0)
            dh, dc = dz @ wh.T, dc * f
        g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = gx, gh, gc


def _word(rng: np.random.Generator, lo: int = 2, hi: int = 9) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))


def _digits_of(rng: np.random.Generator, k: int) -> str:
    return "".join(map(str, rng.integers(0, 10, k)))


def _luhn_digits(rng: np.random.Generator, k: int) -> str:
    d = _digits_of(rng, k - 1)
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def planted(rng: np.random.Generator, kind: int) -> str:
    """A form of the kind, mostly one that no base pattern finds."""
    pick = lambda *x: str(rng.choice(x))
    spaced = pick("", " ")
    if kind == 0:
        at = pick("@", " at ", " AT ", *(f"{spaced}{o}at{c}{spaced}" for o, c in ("[]", "()", "{}")))
        dot = pick(".", " dot ", " DOT ", *(f"{spaced}{o}dot{c}{spaced}" for o, c in ("[]", "()", "{}"))) if at != "@" or rng.random() < 0.7 else "."
        local = _word(rng) + pick("", "", dot + _word(rng, 1), pick("_", "-", "+") + _word(rng, 1), _digits_of(rng, 2))
        return local + at + dot.join([_word(rng, 2, 10), *([_word(rng, 2, 6)] if rng.random() < 0.2 else []), pick("com", "org", "net", "de", "fr", "es", "co", "io", _word(rng, 2, 5))])
    if kind == 1:
        return pick("[.]", "(.)", " . ", "[dot]", " dot ", ".").join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        d, sep = _luhn_digits(rng, int(rng.choice([13, 15, 16, 16, 16, 19]))), pick("  ", ".", "_", "/", " - ", " ")
        sep = sep if sep != " - " else "- "
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    sep, area = pick(" ", "-", ".", "/"), _digits_of(rng, int(rng.integers(3, 5)))
    head = pick("", "", "", "+" + _digits_of(rng, 2) + " ", "1" + sep)
    return head + pick(f"({area}) ", f"({area})" + sep, area + sep) + sep.join([_digits_of(rng, 3), _digits_of(rng, 4)])


def decoy(rng: np.random.Generator) -> str:
    """Numbers and words near the kinds that are none of them."""
    d = lambda k: _digits_of(rng, k)
    forms = [
        d(int(rng.integers(1, 9))), d(int(rng.integers(9, 20))), f"20{d(2)}-{d(2)}-{d(2)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(2)}:{d(2)}",
        f"{d(1)},{d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(2)}", f"{d(2)}-{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(4)}", f"({d(4)})", f"[{d(1)}]", f"{d(2)} {d(3)}", f"v{d(1)}.{d(2)}.{d(1)}-{d(3)}",
        f"@{_word(rng)}", f"{_word(rng)}@", f"{_word(rng)} at {_word(rng)}", f"{_word(rng)} dot {_word(rng)}", f"the dot at {_word(rng)}", f"{_word(rng)} at {d(2)}.{d(2)}", "".join(rng.choice(list("0123456789abcdef"), 20)), f"{_word(rng)}{d(2)}", f"{_word(rng)}.{_word(rng)}", f"{d(3)} {_word(rng)} {d(3)}",
    ]
    return str(rng.choice(forms))


def labelled_windows(rng: np.random.Generator, n: int, carriers: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Windows of carriers (or of generated words) with planted forms and decoys, and their tags."""
    xs, ys = np.full((n, WINDOW), _OUTSIDE), np.zeros((n, WINDOW), np.int64)
    for r in range(n):
        if carriers and rng.random() < 0.7:
            carrier = carriers[int(rng.integers(0, len(carriers)))]
            at = int(rng.integers(0, max(1, len(carrier) - 4 * WINDOW)))
            words = re.split("(?<= )", carrier[at : at + 4 * WINDOW])
        else:
            words = [w + str(rng.choice([" ", " ", " ", ", ", ". ", "\n", ": "])) for w in (_word(rng, 1, 10) for _ in range(24))]
        text, spans = "", []
        for i, w in enumerate(words):
            if i and i % int(rng.integers(4, 9)) == 0:
                kind = int(rng.integers(-2, len(KINDS)))
                piece = decoy(rng) if kind < 0 else planted(rng, kind)
                spans += [] if kind < 0 else [(kind, len(text), len(text) + len(piece))]
                text += piece + str(rng.choice([" ", " ", ", ", ". ", "\n", "; ", ") "]))
            text += w
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in spans:
            taken[a:b] = True
        spans += [s for s in base_spans(text) if not taken[s[1] : s[2]].any()]
        tags = np.zeros(len(text), np.int64)
        for k, a, b in sorted(spans, key=lambda s: s[1]):
            if not tags[a:b].any():
                tags[a:b] = 2 + 2 * k
                tags[a] = 1 + 2 * k
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        x, y = encode(text)[at : at + WINDOW], tags[at : at + WINDOW]
        if len(y) and y[0] >= 2 and y[0] % 2 == 0:
            y[0] -= 1
        xs[r, : len(x)], ys[r, : len(y)] = x, y
    return xs, ys


@lru_cache(maxsize=2)
def train(carriers: tuple[str, ...] = (), windows: int = 2400, epochs: int = 10, seed: int = 7, batch: int = 60, rate: float = 0.02) -> Tagger:
    """Adam on labelled windows; the same carriers and seed give the same model."""
    rng = np.random.default_rng(seed)
    xs, ys = labelled_windows(rng, windows, carriers)
    model = Tagger.fresh(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(windows)
        for a in range(0, windows, batch):
            take = order[a : a + batch]
            _, g = model.gradient(xs[take], ys[take])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                lr = rate * 0.5 ** (epoch / 4)
                model.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that are read: around each trigger."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _windows(lo: int, hi: int) -> list[tuple[int, int]]:
    """Overlapping windows over a stretch."""
    return [(s, min(hi, s + WINDOW)) for s in range(lo, max(lo + 1, hi - STRIDE), STRIDE)]


def reconcile(found: list[tuple[float, Span]]) -> list[Span]:
    """The set of non-overlapping spans with the largest total score."""
    best: dict[Span, float] = {}
    for score, span in found:
        best[span] = max(score, best.get(span, score))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, choice = [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        take = total[before] + best[s]
        choice.append((take > total[i], before))
        total.append(max(take, total[i]))
    out, i = [], len(spans)
    while i:
        taken, before = choice[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def tagged_spans(tags: np.ndarray, gain: np.ndarray, at: int) -> list[tuple[float, Span]]:
    """Scored spans of a tag sequence that begins at ``at``; an inside tag after another kind begins a span."""
    kind = (tags + 1) // 2
    begins = (tags > 0) & ((tags % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]])))
    out = []
    for p in np.flatnonzero(begins).tolist():
        q = p + 1
        while q < len(tags) and tags[q] == 2 * kind[p]:
            q += 1
        out.append((float(gain[p:q].sum()), (int(kind[p]) - 1, at + p, at + q)))
    return out


def model_spans(model: Tagger, texts: list[str], batch: int = 512) -> list[list[Span]]:
    """Reconciled well-formed spans of each text."""
    stretches = [(r, lo, hi) for r, t in enumerate(texts) for lo, hi in _stretches(t)]
    jobs = [(i, a, b) for i, (_, lo, hi) in enumerate(stretches) for a, b in _windows(lo, hi)]
    codes = {r: encode(texts[r]) for r in {r for r, _, _ in stretches}}
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    whole = {}  # tags, gains and how far each character is from its window's edge, by stretch
    for s in range(0, len(jobs), batch):
        part = jobs[s : s + batch]
        x = np.full((len(part), WINDOW), _OUTSIDE)
        for j, (i, a, b) in enumerate(part):
            x[j, : b - a] = codes[stretches[i][0]][a:b]
        tags, gain = model.viterbi(x)
        for j, (i, a, b) in enumerate(part):
            r, lo, hi = stretches[i]
            y, g = tags[j, : b - a], gain[j, : b - a]
            found[r] += tagged_spans(y, g, a)
            if i not in whole:
                whole[i] = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.full(hi - lo, -1)
            here = slice(a - lo, b - lo)
            depth = np.minimum(np.arange(b - a) if a > lo else WINDOW, np.arange(b - a)[::-1] if b < hi else WINDOW)
            deeper = depth > whole[i][2][here]
            for old, new in zip(whole[i], (y, g, depth), strict=True):
                old[here] = np.where(deeper, new, old[here])
    for i, (tags, gain, _) in whole.items():
        found[stretches[i][0]] += tagged_spans(tags, gain, stretches[i][1])
    good = [[(score, s) for score, s in f if score > 0 and well_formed(s[0], texts[r][s[1] : s[2]])] for r, f in enumerate(found)]
    return [reconcile(f) for f in good]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_all(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) if _BASE_TRIGGER.search(t) else [] for t in texts]
    out = []
    for b, m in zip(base, model_spans(model, texts), strict=True):
        taken = sorted((s, e) for _, s, e in b)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        out.append((b, [x for x in m if not ((i := bisect_right(starts, x[2] - 1)) and reach[i - 1] > x[1])]))
    return out


def unlabelled(text: str) -> bool:
    """Whether some part has a kind's loose form but is no base finding: its tags are not known."""
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base_spans(text):
        taken[a:b] = True
    return any(_HOLDS[k](m[0]) and not taken[m.start() : m.end()].any() for k, form in enumerate(_WELL_FORMED) for m in form.finditer(text))


def carrier_texts(docs: DataFrame, carriers: int) -> tuple[str, ...]:
    """Texts of 200 to 4,000 characters with the smallest hashes of id and text; they only serve as training windows."""
    some = smallest_hashes(docs.where(F.col("doc_id").isNotNull() & F.length("text").between(200, 4000)), carriers, "doc_id", "text")
    return tuple(r["text"] for r in some.select("text").collect() if not unlabelled(r["text"]))


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carriers: int = 200) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row."""
    texts = documents(docs, id_col, text_col)
    params = {k: v.astype(np.float32) for k, v in train(carrier_texts(texts, carriers)).p.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tagger(params)
        for part in parts:
            texts = part["text"].tolist()
            rows = [r for a in range(0, len(texts), 500) for r in find_all(model, texts[a : a + 500])]
            out = {"doc_id": part["doc_id"].astype("Int64")}
            out |= {f"n_{k}": [sum(x[0] == i for x in b) for b, _ in rows] for i, k in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]
            out["spans"] = [_joined(b + m) for b, m in rows]
            out["n_added"] = [len(m) for _, m in rows]
            yield pd.DataFrame(out)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
