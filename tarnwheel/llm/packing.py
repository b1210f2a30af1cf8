"""Documents packed whole into containers of fixed capacity, with little room unused.

Sizes are counted by a public tokenizer in Arrow batches. Documents are hashed into shards of about SHARD_DOCS
documents; each shard is packed on its own, so no task holds more, and each shard wastes a few containers at most.
In a shard items go from the largest down. A container has three capacities: tokens, documents, and attention cost
(the sum of squared sizes). Of the containers that can take an item under all three, the one with the best weighted
score is taken: the smallest norm of what would be left, or the largest dot product of demand and room. Open containers
are kept by their room in tokens, and for each room in order of the attention cost left, so an item looks at one
container a room and the work grows in line with the items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
CAPACITY, MAX_DOCS, SHARD_DOCS = 2048, 256, 8192
#: Weights of tokens, documents and attention cost, each taken as a share of its capacity.
WEIGHTS = (1.0, 0.05, 0.2)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) for every row; a null text has no tokens. Whole texts are tokenized.

    tokenizer: a sentencepiece model file; the driver reads it and sends its bytes (about 0.5 MB) with the task.
    """
    model = open(tokenizer, "rb").read()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            n = [len(x) for x in sp.encode([t or "" for t in b.column(1).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


class _Rooms:
    """Open containers (attention cost left, documents left, number) by their room in tokens; the first and last of each room as arrays."""

    def __init__(self, capacity: int, w: np.ndarray):
        self.open: list[list[tuple[float, int, int]]] = [[] for _ in range(capacity + 1)]
        self.first, self.last = np.full(capacity + 1, np.inf), np.full(capacity + 1, -np.inf)
        self.docs = np.zeros((2, capacity + 1))  # documents left of the first and of the last
        self.w = w

    def _ends(self, room: int) -> None:
        x = self.open[room]
        self.first[room], self.last[room] = (x[0][0], x[-1][0]) if x else (np.inf, -np.inf)
        self.docs[:, room] = (x[0][1], x[-1][1]) if x else 0

    def put(self, room: int, cost: float, docs: int, number: int) -> None:
        insort(self.open[room], (cost, docs, number))
        self._ends(room)

    def take(self, room: int, place: int) -> tuple[float, int, int]:
        x = self.open[room].pop(place)
        self._ends(room)
        return x

    def tightest(self, s: int) -> tuple[int, int] | None:
        """(room, place) of the container in which the least is left; of those with one room the one with the least attention cost left."""
        w, q = self.w, float(s) * s
        c = self.first[s:] - q
        spare = (np.arange(len(c)) * w[0]) ** 2
        score = spare + ((self.docs[0, s:] - 1) * w[1]) ** 2 + (c * w[2]) ** 2
        score[c < 0] = np.inf
        k = int(np.argmin(score))
        best, found = score[k], (s + k, 0) if np.isfinite(score[k]) else None
        for k in np.flatnonzero((c < 0) & (self.last[s:] >= q)):  # the first of this room has too little left, a later one has enough
            if spare[k] >= best:
                break
            x = self.open[s + k]
            place = bisect_left(x, (q,))
            v = spare[k] + ((x[place][1] - 1) * w[1]) ** 2 + ((x[place][0] - q) * w[2]) ** 2
            if v < best:
                best, found = v, (s + int(k), place)
        return found

    def roomiest(self, s: int) -> tuple[int, int] | None:
        """(room, place) of the container with the largest dot product of demand and room."""
        w, q = self.w**2, float(s) * s
        c = self.last[s:]
        score = np.where(c >= q, (np.arange(s, s + len(c)) * s) * w[0] + self.docs[1, s:] * w[1] + np.where(c >= q, c, 0.0) * q * w[2], -np.inf)
        k = int(np.argmax(score))
        return (s + k, len(self.open[s + k]) - 1) if score[k] > -np.inf else None


def best_fit(size: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> np.ndarray:
    """The container of each item; sizes at most capacity. Items of one size are placed in the order given.

    A container leaves the search when not even the smallest item has room in it. An item alone always fits,
    whatever its attention cost.
    """
    rooms = _Rooms(capacity, np.asarray(weights) / np.array([capacity, max_docs, max_cost]))
    find = rooms.roomiest if score == "dot" else rooms.tightest
    bins, n = np.full(len(size), -1), 0
    least = int(size.min()) if len(size) else 0
    for i in np.argsort(-size, kind="stable"):
        s = int(size[i])
        at = find(s)
        if at is None:
            room, cost, docs, k = capacity, float(max_cost), max_docs, n
            n += 1
        else:
            room = at[0]
            cost, docs, k = rooms.take(*at)
        bins[i] = k
        room, cost, docs = room - s, cost - float(s) * s, docs - 1
        if room >= least and docs >= 1 and cost >= float(least) ** 2:
            rooms.put(room, cost, docs, k)
    return bins


def _packed(capacity: int, max_docs: int, max_cost: float, weights: tuple, score: str):
    def run(t: pa.Table) -> pa.Table:
        key, n = t.column("k").combine_chunks(), np.asarray(t.column("n_tokens").combine_chunks())
        order = np.asarray(pa.compute.sort_indices(pa.table({"n": -n, "k": key}), sort_keys=[("n", "ascending"), ("k", "ascending")]))
        whole = n // capacity * (n > capacity)
        rest = n - whole * capacity
        piece_of = np.repeat(order, (whole + ((rest > 0) | (n == 0)))[order])
        first = np.r_[True, piece_of[1:] != piece_of[:-1]]
        at = np.flatnonzero(first)
        piece = np.arange(len(piece_of)) - np.repeat(at, np.diff(np.r_[at, len(piece_of)]))
        size = np.minimum(n[piece_of] - piece * capacity, capacity)
        bins = best_fit(size, capacity, max_docs, max_cost, weights, score)
        shard = t.column("shard")[0].as_py()
        return pa.table([key.take(pa.array(piece_of)), pa.array(piece), pa.array(piece * capacity), pa.array(size), pa.array((shard << 32) + bins)], names=["k", "piece", "from_token", "n_tokens", "container"])

    return run


def pack(
    df: DataFrame, key: str, text: str, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(key, piece, from_token, n_tokens, container): every document's place.

    A document of at most `capacity` tokens is one piece; a larger one is cut into full pieces, alone in their
    containers, and a rest that is packed as an item. Empty and null texts are items of no tokens and take a
    document's place. max_cost: attention cost of a container, by default capacity squared (an item alone
    always fits). Rows with the same key are separate items; a null key is kept. An empty table packs into nothing.
    """
    sized = cut(token_counts(df, key, text, tokenizer))
    shards = max(1, round(sized.count() / shard_docs))
    cost = float(max_cost if max_cost is not None else capacity * capacity)
    t = sized.select(F.col(key).alias("k"), "n_tokens", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    kind = dict(df.dtypes)[key]
    t = t.repartition(shards, "shard")  # a fixed number: by bytes AQE would pack all shards in few tasks
    res = t.groupBy("shard").applyInArrow(_packed(capacity, max_docs, cost, weights, score), f"k {kind}, piece bigint, from_token bigint, n_tokens bigint, container bigint")
    return res.withColumnRenamed("k", key)


def fill(packed: DataFrame) -> DataFrame:
    """(container, n_docs, n_tokens, cost) of each container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
