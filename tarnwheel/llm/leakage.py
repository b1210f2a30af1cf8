"""Evaluation passages in training text, found with suffix arrays of the training documents.

The documents are read once: each task makes shards of about SHARD_TOKENS tokens and for every shard the array of all
its suffixes in order. Shards are written as rows (words of all documents; characters of those in scripts without
blanks, and of the others if some item calls for it), and any number of test sets can be searched against them. Test
items are sent to every task in blocks of bounded size, one block after another. A task looks up every suffix of every
item by binary search: depth by depth the range of training suffixes that begin like the test suffix narrows. A range
that is left at the least length of a passage holds all its places; each is followed to the longest verbatim match.
Items in scripts without blanks are matched by characters, others by words. Words are kept as 64-bit hashes, ranked
within their shard. Documents are never shuffled, and whole texts are searched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MIN_WORDS, MIN_CHARS, BY_CHARS = 12, 26, ("zh", "ja")
SHARD_TOKENS = 1_000_000
#: Places of matches that are followed at once.
MATCHES = 2_000_000
#: Characters of test items that the driver and a task hold; more items are searched in further passes over the shards.
BLOCK_CHARS = 16_000_000
#: What a shard is made of: words of all documents, characters of documents with Han or kana, characters of all others.
KINDS = ("words", "wide", "other")
SHARD = "kind string, docs binary, starts binary, vocabulary binary, tokens binary, suffixes binary"
OUT = "doc bigint, item bigint, longest bigint, doc_token bigint, item_token bigint"
WORD, SYMBOL = r"[\p{L}\p{M}\p{N}]+", r"[\p{L}\p{N}]"
WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}]"


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in the order of their first `depth` tokens at least; ties in order of place.

    Prefix doubling, which begins with as many tokens as fit into one number. Tokens are small whole numbers from 0.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    bits = (int(tokens.max()) + 1).bit_length()
    k = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for j in range(k):  # 0 beyond the end
        key <<= bits
        key[: n - j] += tokens[j:].astype(np.int64) + 1 if j < n else 0
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.r_[True, s[1:] != s[:-1]]
        if k >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 2)
        key[:-k] += rank[k:] if k < n else 0
        k *= 2


def narrow(tokens: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ranges [lo, hi) of suffixes alike up to depth, the parts whose next token is `want`; by binary search."""

    def bound(right: bool) -> np.ndarray:
        a, z = lo.copy(), hi.copy()
        while (a < z).any():
            mid = (a + z) >> 1
            at = sa[np.minimum(mid, len(sa) - 1)] + depth
            t = tokens[np.minimum(at, len(tokens) - 1)]
            go = (a < z) & ((t <= want) if right else (t < want))
            a, z = np.where(go, mid + 1, a), np.where((a < z) & ~go, mid, z)
        return a

    first = bound(False)
    return first, np.maximum(first, bound(True))


def _narrow_runs(tokens: list[str], wide: regex.Pattern) -> Iterator[list[str]]:
    """The runs of tokens free of Han and kana."""
    return (list(g) for is_wide, g in groupby(tokens, lambda c: bool(wide.search(c))) if not is_wide)


def word_code(word: str) -> int:
    return (xxhash.xxh64_intdigest(word) >> 1) + 1


class Items:
    """Test items as sequences of token codes, 0 at their ends; suffixes shorter than what must match are left out."""

    def __init__(self, rows: list[tuple[int, str]], pattern: str, least: int):
        find = regex.compile(pattern).findall
        seqs = [(i, find(folded(t or ""))) for i, t in rows]
        seqs = [(i, s) for i, s in seqs if s]
        code = word_code if pattern == WORD else ord
        self.item = np.array([i for i, _ in seqs], np.int64)
        size = np.array([len(s) for _, s in seqs], np.int64)
        self.codes = np.array([x for _, s in seqs for x in (*map(code, s), 0)], np.int64)
        start = np.cumsum(size + 1) - size - 1
        need = np.minimum(size, least)
        count = size - need + 1
        self.owner = np.repeat(np.arange(len(seqs)), count)
        self.begin = start
        self.at = start[self.owner] + np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count) if len(seqs) else np.zeros(0, np.int64)
        self.need = need[self.owner] if len(seqs) else np.zeros(0, np.int64)
        self.depth = int(need.max()) if len(seqs) else 0
        wide = regex.compile(WIDE)
        #: Whether some item has a passage free of Han and kana.
        self.narrow = pattern == SYMBOL and any(any(len(run) >= k for run in _narrow_runs(s, wide)) for (_, s), k in zip(seqs, need))

    def search(self, tokens: np.ndarray, sa: np.ndarray, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(suffix, place, length) of each leftmost beginning of a match in tokens (ranks in the vocabulary from 1, 0 between documents), MATCHES places at a time."""
        if not len(tokens) or not len(self.at):
            return
        mine = np.searchsorted(vocabulary, self.codes)
        known = (mine < len(vocabulary)) & (vocabulary[np.minimum(mine, len(vocabulary) - 1)] == self.codes) if len(vocabulary) else np.zeros(len(mine), bool)
        mine = np.where(known, mine + 1, np.where(self.codes == 0, 0, -1))  # -1: a word that the shard has not
        live = np.arange(len(self.at))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(self.depth):
            lo, hi = narrow(tokens, sa, lo, hi, j, mine[self.at[live] + j])
            full = (hi > lo) & (self.need[live] == j + 1)
            done.append((live[full], lo[full], hi[full]))
            keep = (hi > lo) & (self.need[live] > j + 1)
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
        live, lo, hi = (np.concatenate(x) for x in zip(*done))
        part = np.cumsum(hi - lo) // MATCHES
        for k in np.unique(part):
            here = part == k
            yield self._places(tokens, sa, mine, live[here], lo[here], hi[here])

    def _places(self, tokens: np.ndarray, sa: np.ndarray, mine: np.ndarray, live: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = hi - lo
        s = np.repeat(live, n)
        p = sa[np.repeat(lo, n) + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)]
        q = self.at[s]
        inside = (q > self.begin[self.owner[s]]) & (p > 0)
        left = ~(inside & (tokens[np.maximum(p - 1, 0)] == mine[np.maximum(q - 1, 0)]))
        s, p, q = s[left], p[left], q[left]
        size = self.need[s].copy()
        on = np.arange(len(s))
        while len(on):  # the longest match at each place
            a, b = q[on] + size[on], p[on] + size[on]
            ok = (mine[a] > 0) & (b < len(tokens))
            ok &= mine[a] == tokens[np.minimum(b, len(tokens) - 1)]
            on = on[ok]
            size[on] += 1
        return s, p, size


class _Shard:
    """Documents' tokens as they gather."""

    def __init__(self, kind: str, depth: int):
        self.kind, self.depth = kind, depth
        self.docs: list[int] = []
        self.starts, self.n = [0], 0
        self.words: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        # words as a list; of characters what is left without the others
        self.find = regex.compile(WORD).findall if kind == "words" else partial(regex.compile(r"[^\p{L}\p{N}]+").sub, "")

    def add(self, doc: int, text: str) -> None:
        found = self.find(text)
        if not found:
            return
        if self.kind == "words":
            ids = self.words
            part = np.array([ids.setdefault(w, len(ids) + 1) for w in found], np.int64)
        else:
            part = np.frombuffer(found.encode("utf-32-le"), "<u4").astype(np.int64)
        self.parts += [part, np.zeros(1, np.int64)]
        self.n += len(part) + 1
        self.docs.append(doc)
        self.starts.append(self.n)

    def row(self) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        if self.kind == "words":
            codes = np.array([word_code(w) for w in self.words], np.int64)
            vocabulary, rank = np.unique(codes, return_inverse=True)
            tokens = np.r_[0, rank + 1][tokens]
        else:
            vocabulary, rank = np.unique(tokens, return_inverse=True)
            vocabulary, tokens = vocabulary[1:], rank  # 0 is there: it ends every document
        sa = suffix_array(tokens, self.depth)
        cols = np.array(self.docs, "<i8"), np.array(self.starts, "<i8"), vocabulary.astype("<i8"), tokens.astype("<i4"), sa.astype("<i4")
        return pa.RecordBatch.from_arrays([pa.array([self.kind]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[c.split()[0] for c in SHARD.split(", ")])


def suffix_shards(docs: DataFrame, doc: str, text: str, kinds: tuple[str, ...] = KINDS, depth_words: int = MIN_WORDS, depth_chars: int = MIN_CHARS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(kind, docs, starts, vocabulary, tokens, suffixes): the shards of all documents, to be written once and searched often.

    Suffixes are in order up to depth_words words, depth_chars characters at least; no test item may need more. A
    document lies in one shard of a kind, however long it is. Null ids and texts are left out; an empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = regex.compile(WIDE)
        new = lambda k: _Shard(k, depth_words if k == "words" else depth_chars)
        held = {k: new(k) for k in kinds}
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = folded(t)
                for k in ("words", "wide" if wide.search(t) else "other"):
                    if k in held:
                        held[k].add(d, t)
                        if held[k].n >= shard_tokens:
                            yield held[k].row()
                            held[k] = new(k)
        for s in held.values():
            if s.n:
                yield s.row()

    d = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    return d.mapInArrow(run, SHARD)


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                owner, begin, vocabulary, tokens, sa = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in zip(range(1, 6), ("<i8", "<i8", "<i8", "<i4", "<i4")))
                for s, p, size in items.search(tokens, sa, vocabulary):
                    if not len(s):
                        continue
                    k = np.searchsorted(begin, p, "right") - 1
                    doc, own = owner[k], items.owner[s]
                    order = np.lexsort((p, -size, own, doc))
                    first = order[np.r_[True, (doc[order][1:] != doc[order][:-1]) | (own[order][1:] != own[order][:-1])]]
                    cols = doc[first], items.item[own[first]], size[first], (p - begin[k])[first], (items.at[s] - items.begin[own])[first]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["doc", "item", "longest", "doc_token", "item_token"])

    return run


def search(shards: Callable[[str], DataFrame], items: DataFrame, item: str, item_text: str, item_lang: str, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, longest, doc_token, item_token): see leaks(). shards: gives the shards of a kind."""
    by_chars = F.coalesce(F.col(item_lang).isin(*BY_CHARS), F.lit(False))
    t = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t"), by_chars.alias("c")).where("i is not null and t is not null").distinct()
    total = t.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    parts = []
    for k in range(blocks):
        rows = (t.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) if blocks > 1 else t).collect()
        rows.sort(key=lambda r: (r["i"], r["t"]))
        for sets, pattern, least, chars in ((("words",), WORD, min_words, False), (("wide", "other"), SYMBOL, min_chars, True)):
            use = Items([(r["i"], r["t"]) for r in rows if r["c"] == chars], pattern, least)
            for kind in sets:
                if len(use.at) and (kind != "other" or use.narrow):
                    found = shards(kind).mapInArrow(_search(use), OUT)
                    parts.append(cut(found) if blocks > 1 else found)  # with more blocks, each is done and let go before the next
    if not parts:
        return t.sparkSession.createDataFrame([], OUT)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.min(F.struct((-F.col("longest")).alias("n"), "doc_token", "item_token")).alias("b")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", (-F.col("b.n")).alias("longest"), "b.doc_token", "b.item_token")


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, item_lang: str, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, shard_tokens: int = SHARD_TOKENS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, longest, doc_token, item_token): each document that holds a passage of an item, with the longest one.

    A passage is min_words successive words of the item, or all of an item that has fewer; of items in a BY_CHARS
    language min_chars successive letters and digits, or all. Texts are compared after NFKC and case folding; words are runs of
    letters, marks and digits. Documents with a null id or text, and items with a null id or no words, match nothing.
    Of equally long passages the first in the document is given. Repeated rows give one row. Empty tables give an
    empty result. Items are read in blocks of block_chars characters, so the test set may grow.
    """
    made: dict[str, DataFrame] = {}

    def shards(kind: str) -> DataFrame:
        if kind not in made:  # words and wide ones, needed by nearly every test set, in one reading of the texts
            kinds = ("other",) if kind == "other" else KINDS[:2]
            rows = cut(suffix_shards(docs, doc, text, kinds, min_words, min_chars, shard_tokens))
            made.update({k: rows.where(F.col("kind") == k) for k in kinds})
        return made[kind]

    found = search(shards, items, item, item_text, item_lang, min_words, min_chars, block_chars)
    return found.withColumnRenamed("doc", doc).withColumnRenamed("item", item)


def without_leaks(docs: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """The documents that hold no passage."""
    return docs.join(found.select(doc).distinct(), doc, "left_anti")
