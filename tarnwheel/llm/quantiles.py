"""Percentiles per group with bounded rank error, from summaries that add up.

A summary is a stack of count-sketches, one for each binary resolution of the encoded values: at level l a value
counts under the dyadic interval code >> l. Levels with at most WIDTH intervals are counted exactly; each finer one
has DEPTH rows of WIDTH signed counters. Counters are sums of signs, so summaries of partitions, days or longer spans
add up, and subtracting one deletes its values. A rank is inverted by going down from the coarsest level: left child
if its estimated count reaches the rank that is left, else right.

Encoding keeps order: sign, exponent and PRECISION bits of mantissa, so integers below 2**PRECISION in size are exact.

A summary with at most LISTED distinct codes is written as the list of them, from which the same counters follow, so
small groups take no more room than their values.

Bound. In one row of a sketched level, an estimate is off by what falls into its cell from other values. Of these, let
the k heaviest collide with probability k / WIDTH at most; the others have a sum of squares of at most n**2 / 4k, so
their part has a standard deviation of at most n / (2 sqrt(k WIDTH)). With k = 64 that is 0.14 % of n, whatever the
data, and three of the five rows hold a collision with probability 10 (k / WIDTH)**3 = 0.03 % at most. The median of
five such rows has about 0.6 of one row's deviation; over the EXACT sketched levels on the way down the errors add up
as independent ones to 0.4 % of n at most. Most data are far below (p5_rank_error: no percentile of any group above 1 %).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cpus

PRECISION, WIDTH, DEPTH = 30, 2048, 5
#: Bits of a code: the sign, and up to 34 exponents with half of the mantissas each.
BITS = PRECISION + 6
#: Levels below this one are sketched, those from it on are exact.
EXACT = BITS - (WIDTH.bit_length() - 1)
SIZE = EXACT * DEPTH * WIDTH + 2 * WIDTH
SALTS = 8
#: Distinct codes up to which a summary is written as a list.
LISTED = 4096
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def encode(v: np.ndarray) -> np.ndarray:
    """Codes in [0, 2**BITS), in the order of the values."""
    v = np.asarray(v, np.int64)
    a = np.where(v < 0, ~v, v)
    size = np.frexp(a.astype(np.float64))[1].astype(np.int64)
    size -= (a >> np.maximum(size - 1, 0)) == 0  # where the float was rounded up to the next power of two
    e = np.maximum(size - PRECISION, 0)
    code = (e << (PRECISION - 1)) + (a >> e)
    half = 1 << (BITS - 1)
    return np.where(v < 0, half - 1 - code, half + code)


def decode(code: int) -> int:
    """The value nearest to 0 with this code."""
    half = 1 << (BITS - 1)
    c = half - 1 - code if code < half else code - half
    e = max((c >> (PRECISION - 1)) - 1, 0)
    a = (c - (e << (PRECISION - 1))) << e
    return ~a if code < half else a


def _cells(level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sign) of each node in each row of a sketched level; both have shape (DEPTH, nodes)."""
    x = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD) ^ np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    h = x[None, :] * _MULT[:DEPTH, None]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    col = (h >> np.uint64(64 - (WIDTH.bit_length() - 1))).astype(np.int64)
    sign = 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return (level * DEPTH + np.arange(DEPTH))[:, None] * WIDTH + col, sign


def add(counters: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
    """Counts values (deletes them, under negative weights) in dense counters."""
    _count(counters, *_summed(encode(values), np.asarray(weights, np.int64)))


def _summed(code: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their weights added up."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    return code[first], np.add.reduceat(w[order], first) if len(code) else w


def _count(counters: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
    """Counts distinct codes, in order, at every level."""
    if not len(code):
        return
    for level in range(BITS):
        node = code >> level
        if level:
            new = np.r_[True, node[1:] != node[:-1]]
            first = np.flatnonzero(new)
            node, nw = node[first], np.add.reduceat(w, first)
        else:
            nw = w
        if level >= EXACT:
            counters[EXACT * DEPTH * WIDTH + (1 << (BITS - level)) - 2 + node] += nw
        else:
            cell, sign = _cells(level, node)
            np.add.at(counters, cell.ravel(), (sign * nw).ravel())


def pack(counters: np.ndarray) -> bytes:
    """The counters that are not zero: their number, gaps between their places, their values; compressed."""
    at = np.flatnonzero(counters)
    gaps = np.diff(at, prepend=0).astype("<u4")
    return zstandard.compress(np.uint32(len(at)).tobytes() + gaps.tobytes() + counters[at].astype("<i8").tobytes(), 1) if len(at) else b""


def merge(counters: np.ndarray, blob: bytes, sign: int = 1) -> None:
    """Adds (or, with sign -1, subtracts) a packed summary."""
    if blob[:1] == b"L":
        code, w = _listed(blob)
        _count(counters, code, sign * w)
    elif blob:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        at = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
        counters[at] += sign * np.frombuffer(raw, "<i8", n, 4 + 4 * n)


def _listed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(zstandard.decompress(blob[1:]), "<i8").reshape(2, -1))


class Summary:
    """A summary as it grows: a list of codes up to LISTED of them, counters beyond."""

    def __init__(self):
        self.counters: np.ndarray | None = None
        self.code, self.w = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray, w: np.ndarray) -> None:
        if self.counters is not None:
            _count(self.counters, *_summed(code, w))
            return
        self.code, self.w = _summed(np.r_[self.code, code], np.r_[self.w, w])
        if len(self.code) > LISTED:
            self._expand()

    def _expand(self) -> None:
        self.counters = np.zeros(SIZE, np.int64)
        _count(self.counters, self.code, self.w)

    def merge(self, blob: bytes, sign: int = 1) -> None:
        if blob[:1] == b"L":
            code, w = _listed(blob)
            self.add(code, sign * w)
        elif blob:
            if self.counters is None:
                self._expand()
            merge(self.counters, blob, sign)

    def n(self) -> int:
        return int(self.w.sum()) if self.counters is None else count(self.counters)

    def packed(self) -> bytes:
        if self.counters is not None:
            return pack(self.counters)
        some = self.w != 0
        return b"L" + zstandard.compress(np.stack([self.code[some], self.w[some]]).astype("<i8").tobytes(), 1) if some.any() else b""


def count(counters: np.ndarray) -> int:
    """Values counted, exactly."""
    return int(counters[EXACT * DEPTH * WIDTH :][:2].sum())


def quantile(counters: np.ndarray, q: float) -> int | None:
    """The value at rank ceil(q n) of n, about; None for an empty summary."""
    n = count(counters)
    if n <= 0:
        return None
    left, node, parent = max(1, int(np.ceil(q * n))), 0, n
    for level in range(BITS - 1, -1, -1):
        child = np.array([2 * node, 2 * node + 1])
        if level >= EXACT:
            c = counters[EXACT * DEPTH * WIDTH + (1 << (BITS - level)) - 2 + child]
        else:
            cell, sign = _cells(level, child)
            c = np.clip(np.median(counters[cell] * sign, axis=0), 0, parent)
            c = c * parent / c.sum() if c.sum() > 0 else c  # the children make up their parent
        if left <= c[0] or c[1] <= 0:
            node, parent = 2 * node, c[0]
        else:
            left, node, parent = left - c[0], 2 * node + 1, c[1]
        left = min(left, parent)
    return decode(node)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (module, name, day, salt, v, w) in order of the key become one summary a key; one key's counters are held."""
    key, held = None, Summary()

    def out(key: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.string()), pa.array([key[2]], pa.int64()), pa.array([held.packed()], pa.binary())], names=["k1", "k2", "day", "sketch"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(4)]
        v, w = np.asarray(b.column(4)), np.asarray(b.column(5))
        ids = np.zeros(b.num_rows, np.int64)
        for c in cols:
            code = np.asarray(c.dictionary_encode().indices.fill_null(-1)).astype(np.int64)
            ids = ids * (code.max() + 2) + code + 1
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        for a, z in zip(first, np.r_[first[1:], len(ids)]):
            k = tuple(c[int(a)].as_py() for c in cols)
            if k != key:
                if key is not None:
                    yield out(key)
                key, held = k, Summary()
            held.add(encode(v[a:z]), w[a:z])
    if key is not None:
        yield out(key)


def _merged(span: str | None):
    """Adds the summaries of a group (subtracts those with a sign of -1); span: the name under which the sum is kept, if it has one."""

    def run(t: pa.Table) -> pa.Table:
        held = Summary()
        signs = t.column("sign").to_pylist() if "sign" in t.column_names else [1] * t.num_rows
        for blob, sign in zip(t.column("sketch"), signs):
            held.merge(blob.as_py(), sign)
        keys = [c for c in t.column_names if c in ("k1", "k2", span)]
        return pa.table({**{c: t.column(c).slice(0, 1) for c in keys}, "n": pa.array([held.n()], pa.int64()), "sketch": pa.array([held.packed()], pa.binary())})

    return run


def daily_summaries(df: DataFrame, k1: str, k2: str, time_ms: str, value: str, salt_by: str) -> DataFrame:
    """(k1, k2, day, n, sketch): a summary per group and UTC day.

    Rows with a null value or time are not counted; a null in k1 or k2 is a group of its own. Rows alike in all
    five columns count once (salt_by tells apart rows that are not copies). Equal values are counted before they
    reach Python, and a group's day is built in SALTS parts, so a hot group is spread.
    """
    t = df.select(F.col(k1).cast("string").alias("k1"), F.col(k2).cast("string").alias("k2"), F.col(time_ms).cast("bigint").alias("t"), F.col(value).cast("bigint").alias("v"), F.col(salt_by).alias("id"))
    t = t.where("t is not null and v is not null").distinct()
    day = F.floor(F.col("t") / 86_400_000).alias("day")
    keys = ["k1", "k2", "day", "salt"]
    parts = t.select("k1", "k2", day, F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt"), "v").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("w"))
    spark = df.sparkSession  # a fixed number of tasks: by bytes, the few that AQE would leave have much to count
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cpus(spark))
    parts = parts.repartition(tasks, *keys).sortWithinPartitions(*keys, "v").select(*keys, "v", "w")
    sketched = parts.mapInArrow(_sketch, "k1 string, k2 string, day bigint, sketch binary")
    return sketched.groupBy("k1", "k2", "day").applyInArrow(_merged("day"), "k1 string, k2 string, day bigint, n bigint, sketch binary")


def combine(summaries: DataFrame, span_days: int | None = None) -> DataFrame:
    """Summaries of spans of span_days days (day is then the span's first day), or of all days (no day)."""
    if span_days:
        s = summaries.select("k1", "k2", (F.floor(F.col("day") / span_days) * span_days).alias("day"), "sketch")
        return s.groupBy("k1", "k2", "day").applyInArrow(_merged("day"), "k1 string, k2 string, day bigint, n bigint, sketch binary")
    s = combine(summaries, 32).select("k1", "k2", "sketch")  # in two steps, so that no task holds all days at once
    return s.groupBy("k1", "k2").applyInArrow(_merged(None), "k1 string, k2 string, n bigint, sketch binary")


def subtract(summaries: DataFrame, other: DataFrame) -> DataFrame:
    """summaries with the values of other deleted: both combined over the same span, one row a group (and day, where they have one).

    What is in other must be in summaries. Groups of which nothing is left give no row; those only in other are passed over.
    """
    keys = [c for c in summaries.columns if c in ("k1", "k2", "day")]
    both = summaries.select(*keys, F.lit(1).alias("sign"), "sketch").unionByName(other.select(*keys, F.lit(-1).alias("sign"), "sketch"))
    kinds = ", ".join(f"{c} {t}" for c, t in summaries.dtypes if c in keys)
    return both.groupBy(*keys).applyInArrow(_merged("day"), f"{kinds}, n bigint, sketch binary").where("n > 0")


def percentiles(summaries: DataFrame, qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """summaries with an array column of the percentiles instead of the sketch, and one row a percentile."""
    names = [c for c in summaries.columns if c != "sketch"]
    kinds = dict(summaries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = []
            for blob in b.column(b.schema.get_field_index("sketch")):
                counters = np.zeros(SIZE, np.int64)
                merge(counters, blob.as_py())
                rows.append([quantile(counters, q) for q in qs])
            i = np.repeat(np.arange(b.num_rows), len(qs))
            cols = [b.column(b.schema.get_field_index(c)).take(pa.array(i)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(qs) * b.num_rows, pa.float64()), pa.array([x for r in rows for x in r], pa.int64())], names=[*names, "q", "value"])

    return summaries.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", q double, value bigint")
