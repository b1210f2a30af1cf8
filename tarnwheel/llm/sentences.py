"""Sentence units of documents in many languages and scripts, by a linear-chain model with Viterbi decoding.

Every character is tagged as a boundary (a sentence ends with it) or as inside. The model sees characters: their
classes and n-grams on both sides, the words beside an end mark, what closes after it, and the paragraph; all as
hashed features whose weights were learnt (sentence_training.py). Transition weights belong to the tags of two
successive open characters and their distance. A character is closed (inside with certainty) where training never saw a
boundary between its class and the class of the next one; all others are open. There are two modes. In the first only characters at end
marks, or at what stands for them in their script, are open. A paragraph in which that finds no boundary, and which has
no end mark at its own end either, is read again with the characters open after which sentences end where all end
marks are taken out; of these training has seen real ones (headings, texts cut short) and made ones. Characters within one pair of quotes or brackets cannot be boundaries, and an empty line always is one.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH = re.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:(?:\r?\n|\r)\s*)+| \s*")
PAIR = re.compile(r'[“”„«»「」『』（）()\[\]"]')
CLOSES = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "“": "„"}
#: Classes of characters.
(EDGE, UPPER, LOWER, NOCASE, THAI, HAN, KANA, DIGIT, BLANK, LINE, DOT, DOTS, STRONG, BAR, COMMA, COLON, OPEN, CLOSE, STRAIGHT, DASH, OTHER) = range(21)
N_CLASSES = 21
SPECIAL = {
    **dict.fromkeys(".．", DOT), "…": DOTS, **dict.fromkeys("!?。｡！？।॥؟۔", STRONG), "|": BAR, **dict.fromkeys(",，،、;；؛", COMMA), **dict.fromkeys(":：", COLON),
    **dict.fromkeys("„«「『（([¿¡‘", OPEN), **dict.fromkeys("”»」』）)]’", CLOSE), **dict.fromkeys('"“', STRAIGHT), **dict.fromkeys("\n\r\v\f\x85 ", LINE), "\0": EDGE,
}
MARKS, LETTERS = (DOT, DOTS, STRONG, BAR), (UPPER, LOWER, NOCASE, THAI, HAN, KANA)
#: Bits of a feature's place among the weights; characters that are tagged at once.
BITS, BATCH = 20, 400_000
B = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def class_of(c: str) -> int:
    if c in SPECIAL:
        return SPECIAL[c]
    if c.isspace():
        return BLANK
    o, kind = ord(c), unicodedata.category(c)
    if kind[0] == "N":
        return DIGIT
    if kind[0] in "LM":
        if 0x0E00 <= o < 0x0E80:
            return THAI
        if 0x3040 <= o < 0x3100 or 0xFF66 <= o < 0xFFA0:
            return KANA
        if 0x3005 <= o < 0x3008 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or o >= 0x20000:
            return HAN
        return UPPER if c.isupper() else LOWER if c.islower() or (kind[0] == "M" and o < 0x590) else NOCASE
    return DASH if kind == "Pd" else OTHER


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character of the basic plane; made once in a process."""
    kept = sys.modules.setdefault("_sentence_tables", types.ModuleType("_sentence_tables")).__dict__
    if "tables" not in kept:
        kept["tables"] = _made_tables()
    return kept["tables"]


def _made_tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(0x10000, dtype=np.uint32)
    cls = np.full(0x10000, OTHER, np.uint8)
    for o in range(0x10000):
        if not 0xD800 <= o < 0xE000:
            c = chr(o)
            cls[o] = class_of(c)
            if len(c.lower()) == 1:
                low[o] = ord(c.lower())
    return cls, low


def pairs_of(p: str, cut_short: bool) -> dict[int, int]:
    """Place of each closing quote or bracket of a paragraph -> place of the one that opens it.

    In a text's last paragraph, which may be cut short, what is still open is closed by the end.
    """
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    waiting: Counter[str] = Counter()
    for m in PAIR.finditer(p):
        c, i = m.group(), m.start()
        want = CLOSES.get(c, c if c == '"' else None)
        if want is not None and waiting[want]:
            while True:
                o, at = stack.pop()
                waiting[o] -= 1
                if o == want:
                    found[i] = at
                    break
        elif want is None or c in '“"':
            stack.append((c, i))
            waiting[c] += 1
    if cut_short and stack:
        found[len(p)] = stack[0][1]
    return found


def paragraphs(text: str) -> Iterator[tuple[int, str, bool]]:
    """(offset, paragraph, whether the text ends with it)."""
    at = 0
    for m in [*PARAGRAPH.finditer(text), None]:
        stop = m.start() if m else len(text)
        yield at, text[at:stop], m is None or m.end() == len(text)
        at = m.end() if m else stop


def _last(where: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is marked, -1 without one."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))


def _next(where: np.ndarray) -> np.ndarray:
    """For each place the first one from it on that is marked; the length without one."""
    n = len(where)
    return np.minimum.accumulate(np.where(where, np.arange(n), n)[::-1])[::-1]


class View:
    """Paragraphs laid end to end with an edge on both sides of each, with what the features look at."""

    def __init__(self, parts: list[tuple[str, bool]]):
        text = "\0" + "\0".join([p.replace("\0", " ") for p, _ in parts]) + "\0"
        self.u = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        cls, low = _tables()
        bmp = np.minimum(self.u, 0xFFFF)
        self.cls, self.low = cls[bmp], np.where(self.u < 0x10000, low[bmp], self.u)
        for o in np.flatnonzero(self.u >= 0x10000):
            self.cls[o] = class_of(chr(self.u[o]))
        size = np.array([len(p) + 1 for p, _ in parts])
        self.begin = np.cumsum(size) - size + 1
        self.end = self.begin + size - 1
        n = len(self.u)
        self.para = np.r_[0, np.repeat(np.arange(len(parts)), size)]
        depth = np.zeros(n + 1, np.int32)
        self.matched = np.zeros(n, bool)
        for k, (p, cut_short) in enumerate(parts):
            if PAIR.search(p):
                a = self.begin[k]
                for c, o in pairs_of(p, cut_short).items():
                    depth[a + o] += 1
                    depth[a + c] -= 1
                    self.cls[a + o] = OPEN
                    if c < len(p):
                        self.cls[a + c] = CLOSE
                        self.matched[a + c] = True
        self.inside = np.cumsum(depth)[:n] > 0
        c = self.cls
        white = (c == BLANK) | (c == LINE)
        self.mark = np.isin(c, MARKS)
        self.follow = np.r_[_next(~white)[1:], n - 1]  # the next character that is no white space
        self.black = _last(~white)
        self.core = _last(~white & (c != CLOSE))
        self.run = _last(~self.mark) + 1
        self.strong = np.cumsum((c == STRONG) | (c == BAR))
        self.lines = np.cumsum(c == LINE)
        stop = white | np.isin(c, (EDGE, COMMA, COLON, OPEN, STRAIGHT, STRONG, DOTS, HAN, KANA, CLOSE))
        self.stop, self.token = stop, _last(stop) + 1
        self.word_end = _next(stop | self.mark)
        self.clause_end = _next(self.mark | np.isin(c, (COMMA, COLON, OPEN, CLOSE, STRAIGHT, EDGE)))
        power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, B)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE)])
        self.hash = np.r_[np.uint64(0), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power)]
        self.capital = np.add.reduceat((c == UPPER).astype(np.int64), self.begin) > 0 if parts else np.zeros(0, bool)
        letter = np.isin(c, LETTERS)
        self.script = np.array([np.bincount(c[a:z][letter[a:z]], minlength=1).argmax() if letter[a:z].any() else 0 for a, z in zip(self.begin, self.end)])
        tail = self.core[np.maximum(self.end - 1, self.begin)]
        self.ended = (tail >= self.begin) & self.mark[tail]

    def span(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hashes of the folded texts [a, z)."""
        z = np.maximum(a, z)
        return (self.hash[z] - self.hash[a]) * self.back[np.minimum(a, len(self.back) - 1)]

    def at(self, x: np.ndarray, i: np.ndarray, d: int) -> np.ndarray:
        """x at the places d beside i, none beyond the edges of its paragraph."""
        k = self.para[i]
        return x[np.clip(i + d, self.begin[k] - 1, self.end[k])].astype(np.uint64)


def _mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64, copy=False)) * B
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def _size(x: np.ndarray) -> np.ndarray:
    """Sizes in classes that double."""
    return np.frexp(np.maximum(x, 0).astype(np.float64))[1].astype(np.int64)


def features(v: View, i: np.ndarray, mode: np.ndarray) -> list[np.ndarray]:
    """For each template the places of the weights of characters i."""
    c, m = v.cls, np.where(v.cls[i] == CLOSE, v.core[i], i)
    m = np.maximum(m, v.begin[v.para[i]] - 1)
    marked = v.mark[m]
    a = np.where(marked, v.run[m], m + 1)  # the word before ends here
    strong = (v.strong[m] - np.where(a > 0, v.strong[np.maximum(a - 1, 0)], 0)) > 0
    kind = np.where(~marked, c[m], np.where(strong, 30, 40 + 4 * v.u[m] + np.minimum(m + 1 - a, 3)))
    closed = np.where(m < i, 1 + v.matched[i].astype(np.int64) + 2 * v.u[i].astype(np.int64), 0)
    k = v.follow[i]
    gap = np.where(v.lines[k] > v.lines[i], 2, np.minimum(k - i - 1, 1))
    nxt = c[k].astype(np.int64)
    t = np.maximum(a - 1, 0)
    first = np.where(a > 0, np.minimum(v.token[t], a), 0)
    size = a - first
    shown = np.where(size > 16, a - 3, first)
    tok = v.span(shown, a) + np.minimum(size, 17).astype(np.uint64)
    r = v.black[np.maximum(first - 1, 0)]
    there = (r >= 0) & ~v.stop[r]
    tok2 = np.where(there, v.span(np.maximum(v.token[r], r - 15), r + 1), c[r].astype(np.uint64))
    num2 = np.where(there, c[np.maximum(r, 0)], 0)
    w_end = v.word_end[k]
    word = np.where(w_end - k > 16, v.span(k, np.minimum(k + 3, w_end)), v.span(k, w_end))
    small = ~v.capital[v.para[i]]
    shape = sum(v.at(c, t, -d) << np.uint64(5 * d) for d in range(4))  # the four characters before the mark
    e = v.clause_end[k]
    after = np.where(e < len(c) - 1, v.follow[np.minimum(e, len(c) - 1)], e)
    ends = c[np.minimum(e, len(c) - 1)].astype(np.int64) * 32 + np.where(c[np.minimum(e, len(c) - 1)] == COMMA, c[np.minimum(after, len(c) - 1)], 0)
    last = v.black[np.maximum(e - 1, 0)] + 1
    tails = [v.span(np.maximum(last - n, k), last) for n in (1, 2, 3, 5)]
    length = _size(e - k)
    u = [v.at(v.u, i, d) for d in range(-3, 5)]  # u[3] is the character itself
    q = [v.at(c, i, d) for d in range(-3, 5)]
    g = 8 * gap + 4 * small
    quote = 8 * closed + gap
    here, total = i - v.begin[v.para[i]], v.end[v.para[i]] - v.begin[v.para[i]]
    free = 64 * mode + v.script[v.para[i]]
    one = (m > 0) & (size == 1)
    return [
        _mixed(1, kind, nxt, gap), _mixed(2, kind, nxt, g, closed), _mixed(3, kind, tok), _mixed(4, kind, tok, nxt, gap), _mixed(5, kind, tok, nxt, g), _mixed(6, kind, tok, tok2),
        _mixed(7, kind, shape, nxt, gap), _mixed(8, kind, word, gap), _mixed(9, kind, c[t], word), _mixed(10, kind, one, num2, tok), _mixed(11, kind, tok2, nxt, c[t], size),
        _mixed(12, quote, nxt), _mixed(13, quote, word), _mixed(14, quote, nxt, ends), _mixed(15, closed > 0, nxt, tails[1], length > 5), _mixed(16, closed > 0, tails[2], length), _mixed(17, closed > 0, tails[3]), _mixed(18, closed > 0, nxt, ends, length), _mixed(19, closed > 0, word, ends),
        _mixed(20, closed > 0, nxt, tails[0], ends), _mixed(21, mode, u[3], u[4]), _mixed(22, mode, u[2], u[3], u[4]), _mixed(23, mode, u[3], u[4], u[5]), _mixed(24, mode, u[2], u[3], u[4], u[5]), _mixed(25, mode, u[1], u[2], u[3]),
        _mixed(26, mode, u[4], u[5], u[6]), _mixed(27, mode, u[0], u[1], u[2], u[3]), _mixed(28, mode, u[4], u[5], u[6], u[7]), _mixed(29, mode, q[1], q[2], q[3], q[4], q[5], q[6]), _mixed(30, free, _size(total)), _mixed(31, free, _size(here), _size(total)), _mixed(32, free, _size(total - here), _size(total)),
        _mixed(33, free, q[3], q[4]), _mixed(34, mode, tok, word), _mixed(35, mode, u[1], u[2], u[3], u[4], u[5], u[6]),
    ]


N_TEMPLATES = 35


def near(gap: np.ndarray) -> np.ndarray:
    """Class of the distance between two open characters."""
    return np.digitize(gap, (2, 3, 8, 20))


N_NEAR = 5


def viterbi(score: list[float], gap: list[int], moves: list[list[float]]) -> list[int]:
    """Tags (1: boundary) of a chain with the highest score; moves: by distance the weights of 00, 01, 10, 11."""
    inside, boundary = 0.0, -1e18  # a paragraph begins inside
    back = []
    for s, g in zip(score, gap):
        m = moves[g]
        ii, bi, ib, bb = inside + m[0], boundary + m[2], inside + m[1], boundary + m[3]
        back.append((bi > ii, bb > ib))
        inside, boundary = (bi if bi > ii else ii), (bb if bb > ib else ib) + s
    tag, tags = boundary > inside, []
    for was in reversed(back):
        tags.append(int(tag))
        tag = was[1] if tag else was[0]
    return tags[::-1]


class Model:
    """Emission weights by place, transition weights by (mode, distance, tag before, tag), and which pairs of classes are open in each mode."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, moves: np.ndarray, gates: np.ndarray):
        self.place, self.weight, self.moves, self.gates = place, weight, moves, gates
        self.dense: np.ndarray | None = None

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        with np.load(path or Path(__file__).with_name("sentence_weights.npz")) as f:
            return cls(f["place"], f["weight"].astype(np.float32), f["moves"], f["gates"])

    def save(self, path: str) -> None:
        np.savez_compressed(path, place=self.place.astype(np.int32), weight=self.weight.astype(np.float16), moves=self.moves, gates=self.gates)

    def __getstate__(self):
        return {**self.__dict__, "dense": None}

    def open(self, v: View, mode: int, bare: np.ndarray | None = None) -> np.ndarray:
        """The open characters of a mode; bare: the paragraphs looked at."""
        c = v.cls
        pair = c[:-1].astype(np.int64) * N_CLASSES + c[1:]
        gate = self.gates[0] | self.gates[1] if mode else self.gates[0]
        is_open = gate.ravel()[pair] & ~v.inside[:-1] & (c[v.follow[:-1]] != EDGE)
        return np.flatnonzero(is_open if bare is None else is_open & bare[v.para[:-1]])

    def scores(self, v: View, i: np.ndarray, mode: int) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS, np.float32)
            self.dense[self.place] = self.weight
        s = np.zeros(len(i))
        for f in features(v, i, np.full(len(i), mode)):
            s += self.dense[f]
        return s

    def decode(self, v: View) -> np.ndarray:
        """The characters that are boundaries."""
        hits = self._tagged(v, self.open(v, 0), 0)
        bare = ~v.ended
        bare[v.para[hits]] = False
        return np.sort(np.r_[hits, self._tagged(v, self.open(v, 1, bare), 1)]) if bare.any() else hits

    def _tagged(self, v: View, i: np.ndarray, mode: int) -> np.ndarray:
        if not len(i):
            return i
        s = self.scores(v, i, mode)
        para = v.para[i]
        first = np.r_[True, para[1:] != para[:-1]]
        gap = near(np.where(first, 1000, np.diff(i, prepend=0)))
        moves = self.moves[mode].reshape(N_NEAR, 4).tolist()
        s, gap, cuts = s.tolist(), gap.tolist(), np.flatnonzero(first).tolist()
        tags: list[int] = []
        for a, z in zip(cuts, [*cuts[1:], len(i)]):
            tags += viterbi(s[a:z], gap[a:z], moves)
        return i[np.array(tags, bool)]

    def split(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of every sentence of every text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        held: list[tuple[int, int, str, bool]] = []
        n = 0

        def flush() -> None:
            v = View([(p, short) for _, _, p, short in held])
            hits = self.decode(v)
            at = np.searchsorted(hits, v.begin)
            for k, (row, offset, p, _) in enumerate(held):
                begin = 0
                stop = at[k + 1] if k + 1 < len(held) else len(hits)
                for end in [*(hits[at[k] : stop] - v.begin[k] + 1).tolist(), len(p)]:
                    s = p[begin:end]
                    left = len(s) - len(s.lstrip())
                    if left < len(s):
                        out[row].append((offset + begin + left, offset + begin + len(s.rstrip())))
                    begin = end

        for row, text in enumerate(texts):
            for offset, p, short in paragraphs(text):
                if p and not p.isspace():
                    held.append((row, offset, p, short))
                    n += len(p)
                    if n >= BATCH:
                        flush()
                        held.clear()
                        n = 0
        if held:
            flush()
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.split([text])[0]


def _split(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = model.split([t or "" for t in b.column(1).to_pylist()])
        n = np.array([len(s) for s in found], np.int64)
        ends = np.array([x for s in found for x in s], np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["k", "sent_no", "sent_start", "sent_end"])


def sentences(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, sent_no, sent_start, sent_end): every sentence of every text, as offsets in code points, end exclusive.

    Null, empty and blank texts have no sentences. Sentences carry no white space at their ends; all other characters
    of a text lie in one sentence. Of a paragraph without any end mark the model decides whether it is a heading or
    more than one sentence. Repeated rows are split repeatedly. Whole texts are split, each by itself, with no shuffle;
    an empty table gives an empty result.
    """
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(partial(_split, model or Model.load()), f"k {kind}, sent_no bigint, sent_start bigint, sent_end bigint").withColumnRenamed("k", key)
