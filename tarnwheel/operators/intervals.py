"""Continuous periods and the gaps between them, from overlapping intervals.

Each interval [start, end) is a run of set bits, one bit for each time unit (a
millisecond). Bits are kept in bitmaps per entity and time shard, compressed to
runs: pairs of 32-bit offsets. Bitmaps are united twice, where the rows are read
and after one shuffle by (entity, shard), so that an entity with a third of all
rows is spread over its shards. Shards that an interval fills make one run of a
bitmap a level up, whose bits are whole shards; it is united in the same way, so
an interval of any length is two pieces of bitmaps and one run above. Set runs
inside a shard are periods and clear runs between them gaps, unless the shard is
filled from above; only the first and last run of each shard and the runs from
above go through a window per entity, which joins runs across shard edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Time units of a shard, as a power of two (2**22 ms are 70 minutes).
SHARD_BITS = 22


def unite(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set runs of each group's united bitmaps; offsets lie in [0, 2**32)."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    reach = np.maximum.accumulate((group << 33) | end)
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (((group[1:] << 33) | start[1:]) > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:] - 1, len(group) - 1]
    return group[first], start[first], reach[last] & ((1 << 33) - 1)


def encode(group: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    """A bitmap per group 0..n-1, from runs in order of group: little-endian uint32 pairs (start, length - 1)."""
    data = np.empty((len(group), 2), "<u4")
    data[:, 0], data[:, 1] = start, end - start - 1
    offsets = np.zeros(n + 1, "<i4")
    np.cumsum(np.bincount(group, minlength=n) * 8, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every run of an array of bitmaps."""
    if isinstance(bitmaps, pa.ChunkedArray):
        bitmaps = bitmaps.combine_chunks()
    sizes = np.asarray(pa.compute.binary_length(bitmaps).fill_null(0), np.int64) // 8
    data = np.frombuffer(b"".join(x or b"" for x in bitmaps.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), data[:, 0], data[:, 0] + data[:, 1] + 1


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, start, end) become bitmaps of the shards in which they start and end, united within each batch; shards they fill are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        e, s, t = (np.asarray(b.column(i)) for i in range(3))
        a, z = s >> SHARD_BITS, (t - 1) >> SHARD_BITS
        row, shard = np.r_[np.arange(len(e)), np.flatnonzero(z > a)], np.r_[a, z[z > a]]
        base = shard << SHARD_BITS
        lo, hi = np.maximum(s[row] - base, 0), np.minimum(t[row] - base, 1 << SHARD_BITS)
        part = hi - lo < 1 << SHARD_BITS
        if not part.any():
            continue
        row, shard, lo, hi = row[part], shard[part], lo[part], hi[part]
        order = np.lexsort((shard, e[row]))
        k, h = e[row][order], shard[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
        g = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        g, lo, hi = unite(g, lo[order], hi[order])
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(h[first]), encode(g, lo, hi, len(first))], names=["entity", "shard", "bits"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in order of (entity, shard) become set runs and clear runs; only one key's bitmap waits for the next batch."""
    held: pa.Table | None = None

    def out(t: pa.Table) -> pa.RecordBatch:
        k, h = (np.asarray(t.column(i).combine_chunks()) for i in range(2))
        new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
        first, g = np.flatnonzero(new), np.cumsum(new) - 1
        row, s, e = decode(t.column(2))
        g, s, e = unite(g[row], s, e)
        entity, shard = k[first][g], h[first][g]
        base = shard << SHARD_BITS
        head = np.r_[True, g[1:] != g[:-1]]
        tail = np.r_[g[1:] != g[:-1], True]
        edge = head | tail
        inner = ~head  # a clear run lies before every run but the shard's first
        kind = np.where(edge, "edge", "period")
        before = np.r_[0, e[:-1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[entity, entity[inner]]), pa.array(np.r_[shard, shard[inner]]),
                pa.array(np.r_[kind, np.full(inner.sum(), "gap")].astype(object), pa.string()),
                pa.array(np.r_[base + s, (base + before)[inner]]), pa.array(np.r_[base + e, (base + s)[inner]]),
            ],
            names=["entity", "shard", "kind", "start_ms", "end_ms"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        k, h = (np.asarray(t.column(i).combine_chunks()) for i in range(2))
        same = (k == k[-1]) & (h == h[-1])
        n = int(np.argmax(same))
        held = t.slice(n)
        if held.num_rows > 64:  # a key with many bitmaps: unite those that are here
            row, s, e = decode(held.column(2))
            g, s, e = unite(np.zeros(len(row), np.int64), s, e)
            held = pa.table([pa.array(k[n : n + 1]), pa.array(h[n : n + 1]), encode(g, s, e, 1)], names=t.column_names)
        if n:
            yield out(t.slice(0, n))
    if held is not None:
        yield out(held)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, max_gap_ms: int | None = None) -> DataFrame:
    """(entity, kind, start_ms, end_ms): continuous periods, and the gaps between successive periods.

    df: intervals [start, end) in whole non-negative time units; rows with a null in one of the three
    columns, or with end <= start, are no intervals and are passed over. Intervals that touch are one
    period. max_gap_ms: longer gaps are not listed. Repeated rows change nothing, an empty table gives an
    empty result, other columns are never read, so their names cannot clash. Ends may be filler numbers of any size.
    """
    t = df.select(F.col(entity).cast("bigint").alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    t = t.where("entity is not null and s >= 0 and e > s")
    longest = t.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    periods, gaps = _united(t, longest)
    res = periods.select("entity", F.lit("period").alias("kind"), "start_ms", "end_ms").unionByName(gaps.select("entity", F.lit("gap").alias("kind"), "start_ms", "end_ms"))
    if max_gap_ms is not None:
        res = res.where((F.col("kind") != "gap") | (F.col("end_ms") - F.col("start_ms") <= max_gap_ms))
    return res.withColumnRenamed("entity", entity)


def _united(t: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(periods, gaps), each (entity, start_ms, end_ms), of intervals (entity, s, e) that are no longer than `longest`."""
    bits = t.mapInArrow(_bitmaps, "entity bigint, shard bigint, bits binary")
    runs = (
        bits.repartition("entity", "shard").sortWithinPartitions("entity", "shard")
        .mapInArrow(_runs, "entity bigint, shard bigint, kind string, start_ms bigint, end_ms bigint")
    )
    inside, edges = runs.where("kind <> 'edge'"), runs.where("kind = 'edge'").select("entity", "shard", "start_ms", "end_ms", F.lit(None).cast("bigint").alias("filled"))
    above = longest >= 1 << SHARD_BITS  # no shorter interval fills a shard
    if above:
        first, last = F.shiftright(F.col("s") - 1, SHARD_BITS) + 1, F.shiftright("e", SHARD_BITS)
        whole, _ = _united(t.select("entity", first.alias("s"), last.alias("e")).where("s < e"), longest >> SHARD_BITS)
        up = lambda c: F.shiftleft(c, SHARD_BITS)
        edges = edges.unionByName(whole.select("entity", F.lit(None).cast("bigint").alias("shard"), up("start_ms").alias("start_ms"), up("end_ms").alias("end_ms"), F.col("end_ms").alias("filled")))
    w = Window.partitionBy("entity").orderBy("start_ms", F.desc("end_ms"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        edges.withColumn("reach", F.max("end_ms").over(before)).withColumn("from", F.lag("shard").over(w)).withColumn("filled", F.max("filled").over(before))
        .withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("start_ms") > F.col("reach")), 1).otherwise(0))
        .withColumn("period", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    if above:
        full = edges.where(F.col("filled") > F.col("shard")).select("entity", "shard").distinct()
        inside = inside.join(full, ["entity", "shard"], "left_anti")
    inside = inside.select("entity", "kind", "start_ms", "end_ms")
    joined = edges.groupBy("entity", "period").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    # what lies between two runs of one shard was listed there
    between = edges.where((F.col("fresh") == 1) & F.col("reach").isNotNull() & ~F.coalesce(F.col("from") == F.col("shard"), F.lit(False)))
    periods = inside.where("kind = 'period'").select("entity", "start_ms", "end_ms").unionByName(joined.select("entity", "start_ms", "end_ms"))
    gaps = inside.where("kind = 'gap'").select("entity", "start_ms", "end_ms").unionByName(between.select("entity", F.col("reach").alias("start_ms"), F.col("start_ms").alias("end_ms")))
    return periods, gaps
