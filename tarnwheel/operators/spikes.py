"""Wrong readings in measurements: impossible values, spikes and stuck runs, each against its source's normal.

Work is cut by rank, not by source: distinct reading times are counted per (source, half hour), the running counts say
where each half hour stands in its source's order, and a rank inside the half hour puts every reading into its stretch
of CHUNK successive readings, and with HALO readings also into the neighbour's. So a source with a third of all rows
becomes many equal groups, the rows grow in line with the readings however dense a half hour is, and every reading
still sees those before and after it. A half hour holds at most 1.8 million times. Stretches are hashed into Arrow
groups of about GROUP_ROWS rows.

Normal behaviour is the low-rank part of profile matrices, split off by robust principal components. A source seen on
at least DAYS days has one matrix a metric, a row a day and a column a half hour: its low-rank part is the source's
level at that time of day, and what is left of each reading goes on. In every stretch the readings (less that level),
scaled by the source's own scatter, fold into a matrix of short profiles of WIDTH successive readings, whose low-rank
part holds level, ramps and the two states of some workers. Sparse cells are the candidates for spikes; an exact check
against the levels before and after decides. Ranges are tested separately. Of constant runs a stretch gives the long
ones between and the two at its edges; runs are joined across edges, and whether the metric otherwise changes is judged
from the counts of the whole source.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BUCKET_MS = 1_800_000
CHUNK, HALO, GROUP_ROWS = 1024, 24, 20_000
#: Readings of a profile row; components kept as normal; scatters from the low-rank part to be a candidate.
WIDTH, RANK, CANDIDATE = 8, 2, 5.0
#: Days on which a source must be seen to have daily profiles, and days of one matrix.
DAYS, BLOCK_DAYS = 5, 64
SLOTS = 86_400_000 // BUCKET_MS
#: Scatters from the levels before and after; longest spike; readings of a stuck run; share of unchanged neighbours above which a metric is coarse.
SPIKE, LONGEST, STUCK, COARSE = 10.0, 3, 8, 0.12
LEAST_SAMPLES = 10
FILLERS = (2**31 - 1, 2**31, 2**32 - 1, 2**32, 2**63 - 1, -(2**31), -(2**63))
#: A case, or (without kind) a piece of the runs of equal readings.
PIECE = {
    "source": pa.int64(), "metric": pa.string(), "chunk": pa.int64(), "part": pa.int64(), "value": pa.int64(), "n": pa.int64(), "tail": pa.bool_(),
    "own": pa.int64(), "same": pa.int64(), "stuck": pa.int64(), "runs": pa.int64(), "times": pa.list_(pa.int64()),
}
JUDGED = ["source", "time_ms", "metric", "kind", *list(PIECE)[2:]]
OUT = "source bigint, time_ms bigint, metric string, kind string, chunk bigint, part bigint, value bigint, n bigint, tail boolean, own bigint, same bigint, stuck bigint, runs bigint, times array<bigint>"


def filler(v: Column) -> Column:
    """Values with which a full register or a failed reading is written."""
    return v.isin(*FILLERS) | (v >= F.lit(2**63 - 2**10))


def scatter(y: np.ndarray) -> float:
    """Usual distance from the local level: from the median of seven around each reading; at least one step of the metric."""
    if len(y) < 7:
        return 0.0
    mid = np.sort(np.lib.stride_tricks.sliding_window_view(y, 7), axis=1)[:, 3]
    s = 1.4826 * np.median(np.abs(y[3:-3] - mid)) * 1.08  # the centre is one of the seven
    if s:
        return s
    steps = np.abs(np.diff(y))
    steps = steps[steps > 0]
    return float(np.median(steps)) if len(steps) else 0.0


def low_rank(m: np.ndarray, low: np.ndarray, rank: int, cutoff: float, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(low-rank part, sparse cells) of a matrix, from a first guess of the low-rank part; cells that are NaN are unknown.

    Alternating projections: cells taken for sparse are filled from the low-rank part, so they cannot bend it.
    """
    unknown = np.isnan(m)
    out = unknown | (np.abs(m - low) > cutoff)
    for _ in range(rounds):
        filled = np.where(out, low, m)
        _, v = np.linalg.eigh(filled.T @ filled)
        v = v[:, -rank:]
        low = filled @ v @ v.T
        now = unknown | (np.abs(m - low) > cutoff)
        if (now == out).all():
            break
        out = now
    return low, (out | (np.abs(m - low) > cutoff)) & ~unknown


def sparse_part(z: np.ndarray, width: int = WIDTH, rank: int = RANK, cutoff: float = CANDIDATE) -> np.ndarray:
    """Which of the scaled readings the low-rank part of their profile matrix does not explain."""
    n = len(z)
    rows = -(-n // width)
    m = np.full(rows * width, np.nan)
    m[:n] = z
    m = m.reshape(rows, width)
    if n < rows * width:
        m[-1, n - rows * width :] = np.median(m[-1, : n - rows * width + width])
    first = np.repeat(np.sort(m, axis=1)[:, (width - 1) // 2 : width // 2 + 1].mean(1)[:, None], width, 1)
    return low_rank(m, first, rank, cutoff)[1].ravel()[:n]


def day_levels(m: np.ndarray) -> np.ndarray:
    """The normal level of each cell of a day-by-slot matrix (NaN: not seen): the low-rank part of its daily profiles.

    Each day's own median is taken off first, so that slots of days without readings fall back to the day's level.
    """
    with np.errstate(all="ignore"):
        base = np.array([np.median(r[~np.isnan(r)]) if (~np.isnan(r)).any() else np.nan for r in m])
        base = np.where(np.isnan(base), np.median(base[~np.isnan(base)]), base)[:, None]
        rest = m - base
        shape = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in rest.T])[None, :]
        off = np.abs(rest - shape)
        scale = 1.4826 * np.median(off[~np.isnan(off)]) or 1.0
        low, _ = low_rank(rest / scale, np.repeat(shape / scale, len(m), 0), RANK, CANDIDATE)
    return base + low * scale


def _levels(y: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to w readings before, and after, each reading; NaN with fewer than three."""
    n = len(y)
    before = np.full(n, np.nan)
    if n > w:
        s = np.sort(np.lib.stride_tricks.sliding_window_view(y, w)[:-1], axis=1)
        before[w:] = (s[:, (w - 1) // 2] + s[:, w // 2]) / 2
    for i in range(3, min(w, n)):
        before[i] = np.median(y[:i])
    after = np.full(n, np.nan)
    if n > w:
        s = np.sort(np.lib.stride_tricks.sliding_window_view(y, w)[1:], axis=1)
        after[: n - w] = (s[:, (w - 1) // 2] + s[:, w // 2]) / 2
    for i in range(max(0, n - w), n - 3):
        after[i] = np.median(y[i + 1 :])
    return before, after


def leaves_level(y: np.ndarray, at: np.ndarray, s: float) -> np.ndarray:
    """Which readings, among the candidates `at`, belong to at most LONGEST that leave the level kept before and after."""
    n, hit = len(y), np.zeros(len(y), bool)
    if not s or not len(at):
        return hit
    for w in (6, 3):
        before, after = _levels(y, w)
        for size in range(1, LONGEST + 1):
            for shift in range(size):
                a = at - shift
                a = a[(a >= 0) & (a + size <= n)]
                b0, a0 = before[a], after[a + size - 1]
                apart = np.abs(b0 - a0)
                win = y[a[:, None] + np.arange(size)]
                far = np.minimum(np.abs(win - b0[:, None]), np.abs(win - a0[:, None])).min(1)
                ok = (far > SPIKE * s) & (apart < np.minimum(far / 2, SPIKE / 2 * s))
                hit[(a[ok][:, None] + np.arange(size)).ravel()] = True
    keep = np.zeros(n, bool)
    keep[at] = True
    return hit & keep


def otherwise_changes(n, same, stuck, runs):
    """Whether a metric, of which n readings are counted, changes from reading to reading outside its long runs; for numbers and for columns.

    same: unchanged pairs in shorter runs; stuck, runs: readings in long runs, and how many those are. One that is coarse,
    or idle for most of the time, does not.
    """
    pairs = n - 1 - (stuck - runs)
    return (same <= COARSE * pairs) & (4 * (pairs - same) >= stuck)


def _runs(v: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    return np.diff(np.r_[np.flatnonzero(np.r_[True, v[1:] != v[:-1]]), len(v)]) if len(v) else np.zeros(0, int)


def stuck(v: np.ndarray) -> np.ndarray:
    """Which of a source's successive readings lie in a run of at least STUCK equal ones, where the metric otherwise changes."""
    size = _runs(v)
    long = size >= STUCK
    if not otherwise_changes(len(v), (size[~long] - 1).sum(), size[long].sum(), long.sum()):
        return np.zeros(len(v), bool)
    return np.repeat(long, size)


def _pieces(v: np.ndarray, at: np.ndarray, wrong: np.ndarray) -> list[tuple]:
    """What a stretch tells of the runs in its own readings, as (part, value, n, tail, own, same, stuck, runs, times).

    Its first run (part 0) and its last one (2) may go on in the neighbours; the long runs between make up part 1. The
    totals of what lies between stand at the first run. times: those to be given if the runs prove to be stuck.
    """
    size = _runs(v)
    if not len(size):
        return []
    inner = size[1:-1]
    long = inner >= STUCK
    totals = len(v), (inner[~long] - 1).sum(), inner[long].sum(), long.sum()
    ok, z = ~wrong, len(v) - size[-1]
    out = [(0, v[0], size[0], len(size) == 1, *totals, at[: size[0]][ok[: size[0]]])]
    if long.any():
        mid = np.repeat(np.r_[False, long, False], size) & ok
        out.append((1, 0, 0, False, 0, 0, 0, 0, at[mid]))
    if len(size) > 1:
        out.append((2, v[-1], size[-1], True, 0, 0, 0, 0, at[z:][ok[z:]]))
    return out


def _judge(metrics: list[str]):
    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c) for c in t.column_names}
        i64 = lambda c: np.asarray(col[c].combine_chunks().fill_null(0), np.int64)
        src, chunk, at = i64("source"), i64("chunk"), i64("time_ms")
        order = np.lexsort((*(i64(m) for m in reversed(metrics)), at, chunk, src))
        src, chunk, at = src[order], chunk[order], at[order]
        ranks, total = i64("rank")[order], i64("total")[order]
        cut_at = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (chunk[1:] != chunk[:-1])])
        ends = np.r_[cut_at[1:], len(src)]
        vals = {m: i64(m)[order] for m in metrics}
        null = {m: np.asarray(col[m].combine_chunks().is_null())[order] for m in metrics}
        bad = {m: np.asarray(col["bad_" + m].combine_chunks().fill_null(False))[order] for m in metrics}
        level = {m: np.asarray(col["level_" + m].combine_chunks().fill_null(0.0))[order] for m in metrics if "level_" + m in col}
        found: list[tuple[np.ndarray, str, str]] = []
        pieces: list[tuple] = []
        for a, z in zip(cut_at, ends):
            if total[a] < LEAST_SAMPLES:
                continue
            fresh = np.r_[True, at[a + 1 : z] != at[a : z - 1]]  # the first copy of a reading stands for all
            here = a + np.flatnonzero(fresh)
            last = chunk[a] == stretches(total[a]) - 1
            own = (ranks[here] >= chunk[a] * CHUNK) & (last | (ranks[here] < (chunk[a] + 1) * CHUNK))
            for m in metrics:
                some = ~null[m][here]
                pos, mine = here[some], own[some]
                v, wrong = vals[m][pos], bad[m][pos]
                found.append((pos[wrong & mine], m, "range"))
                pieces += [(src[a], m, chunk[a], *p) for p in _pieces(v[mine], at[pos[mine]], wrong[mine])]
                y = v[~wrong].astype(float)
                s = scatter(y)
                if s:
                    rest = y - level[m][pos[~wrong]] if m in level else y
                    cand = np.flatnonzero(sparse_part((rest - np.median(rest)) / s))
                    found.append((pos[~wrong][leaves_level(y, cand, s) & mine[~wrong]], m, "spike"))
        found = [f for f in found if len(f[0])]
        i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        n = [len(f[0]) for f in found]
        word = lambda k: pa.array(np.repeat(np.array([f[k] for f in found], object), n) if found else [], pa.string())
        cases = pa.table([pa.array(src[i]), pa.array(at[i]), word(1), word(2)], names=["source", "time_ms", "metric", "kind"])
        runs = pa.table([pa.array([p[k] for p in pieces], t) for k, t in enumerate(PIECE.values())], names=list(PIECE))
        return pa.concat_tables([cases, runs], promote_options="default").select(JUDGED)

    return run


def stretches(total):
    """Number of stretches of a source with so many distinct times; the last has half to one and a half of CHUNK."""
    return max(1, (2 * total + CHUNK) // (2 * CHUNK))


def _stuck_runs(pieces: DataFrame) -> DataFrame:
    """(source, time_ms, metric, kind): readings of the long runs of each metric that otherwise changes at its source.

    Runs are joined across the edges of stretches and all counts are of the whole source; only two rows a stretch are put in order.
    """
    by = Window.partitionBy("source", "metric")
    w = by.orderBy("chunk", "part")
    goes_on = (F.col("part") == 0) & F.lag("tail", 1, False).over(w) & F.coalesce(F.col("value") == F.lag("value").over(w), F.lit(False))
    edges = pieces.where("part != 1").drop("times").withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    edges = edges.withColumn("long", F.sum("n").over(Window.partitionBy("source", "metric", "run")) >= STUCK)
    count = lambda inner, edge: F.sum(F.col(inner) + edge).over(by)
    changes = otherwise_changes(
        F.sum("own").over(by),
        count("same", F.when(F.col("long"), 0).otherwise(F.col("n") - F.col("new"))),
        count("stuck", F.when(F.col("long"), F.col("n")).otherwise(0)),
        count("runs", F.when(F.col("long"), F.col("new")).otherwise(0)),
    )
    # the verdict of the first run also holds for the long runs between
    part = F.explode(F.array(F.when(F.col("long"), F.col("part")), F.when(F.col("part") == 0, 1)))
    hits = edges.withColumn("changes", changes).where("changes").select("source", "metric", "chunk", part.alias("part")).where("part is not null")
    return pieces.join(hits, ["source", "metric", "chunk", "part"]).select("source", F.explode("times").alias("time_ms"), "metric", F.lit("stuck").alias("kind"))


def _profiles(metrics: list[str]):
    """Levels of the half hours of each (source, block of days) of a group, from its daily profile matrices."""

    def run(t: pa.Table) -> pa.Table:
        src, block, bucket = (np.asarray(t.column(c).combine_chunks()) for c in ("source", "block", "bucket"))
        order = np.lexsort((bucket, block, src))
        src, block, bucket = src[order], block[order], bucket[order]
        value = {m: np.asarray(t.column(m).combine_chunks().cast(pa.float64()).fill_null(float("nan")))[order] for m in metrics}
        first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (block[1:] != block[:-1])])
        out = {m: np.full(len(src), np.nan) for m in metrics}
        for a, z in zip(first, np.r_[first[1:], len(src)]):
            day, slot = bucket[a:z] // SLOTS, bucket[a:z] % SLOTS
            days, row = np.unique(day, return_inverse=True)
            for m in metrics:
                if not np.isnan(value[m][a:z]).all():
                    x = np.full((len(days), SLOTS), np.nan)
                    x[row, slot] = value[m][a:z]
                    out[m][a:z] = day_levels(x)[row, slot]
        return pa.table([pa.array(src), pa.array(bucket), *(pa.array(out[m], from_pandas=True) for m in metrics)], names=["source", "bucket", *("level_" + m for m in metrics)])

    return run


def _daily_levels(t: DataFrame, counts: DataFrame, metrics: list[str]) -> DataFrame | None:
    """(source, bucket, level_...) for the sources seen on at least DAYS days, by the counts of their half hours; None where there are none."""
    lasting = counts.groupBy("source").agg(F.count_distinct(F.expr(f"bucket div {SLOTS}")).alias("days")).where(F.col("days") >= DAYS)
    rows = lasting.agg(F.sum("days")).first()[0]
    if not rows:
        return None
    mean = [F.avg(F.when(~F.coalesce("bad_" + m, F.lit(False)), F.col(m))).alias(m) for m in metrics]
    means = t.join(lasting.select("source"), "source", "left_semi").groupBy("source", "bucket").agg(*mean).withColumn("block", F.expr(f"bucket div {SLOTS * BLOCK_DAYS}"))
    g = F.pmod(F.xxhash64("source", "block"), F.lit(max(1, rows * SLOTS // GROUP_ROWS)))
    return means.groupBy(g.alias("g")).applyInArrow(_profiles(metrics), "source bigint, bucket bigint, " + ", ".join(f"level_{m} double" for m in metrics))


def wrong_readings(df: DataFrame, source: str, time_ms: str, impossible: Mapping[str, Column]) -> DataFrame:
    """(source, time_ms, metric, kind): readings that are impossible (`range`), a `spike` or `stuck`.

    impossible: metric column -> condition under which its value cannot be. A reading may come out under more
    than one kind. Null readings are none; rows with a null source or time are passed over. Of several rows with
    one source and time the first in order of the values counts, so repeated rows give one case, and ranks and the
    number of samples count distinct times. A source with
    fewer than LEAST_SAMPLES samples gives no cases; a constant metric has no scatter and gives no spikes. Other
    columns are not read further. An empty table gives an empty result.
    """
    metrics = list(impossible)
    t = df.select(
        F.col(source).cast("bigint").alias("source"), F.col(time_ms).cast("bigint").alias("time_ms"),
        *(F.col(m).cast("bigint").alias(m) for m in metrics), *(c.alias("bad_" + m) for m, c in impossible.items()),
    ).where("source is not null and time_ms is not null").withColumn("bucket", F.floor(F.col("time_ms") / BUCKET_MS))
    w = Window.partitionBy("source")
    counts = cut(t.select("source", "bucket", "time_ms").distinct().groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    ranks = counts.withColumn("r0", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(w))
    levels = _daily_levels(t, counts, metrics)
    if levels is not None:
        ranks = ranks.join(levels, ["source", "bucket"], "left")
    inside = F.dense_rank().over(Window.partitionBy("source", "bucket").orderBy("time_ms"))
    joined = t.withColumn("rank", inside.cast("bigint") - 1).join(ranks.drop("n"), ["source", "bucket"]).withColumn("rank", F.col("rank") + F.col("r0")).drop("r0", "bucket")
    near = f"least((rank {{}}) div {CHUNK}, greatest((2 * total + {CHUNK}) div {2 * CHUNK}, 1) - 1)"
    joined = joined.withColumn("chunk", F.explode(F.expr(f"sequence({near.format(f'- least(rank, {HALO})')}, {near.format(f'+ {HALO}')})")))
    joined = joined.withColumn("g", F.pmod(F.xxhash64("source", "chunk"), F.lit(max(1, rows // GROUP_ROWS))))
    judged = cut(joined.groupBy("g").applyInArrow(_judge(metrics), OUT))
    cases = judged.where("kind is not null").select("source", "time_ms", "metric", "kind").unionByName(_stuck_runs(judged.where("kind is null").drop("time_ms", "kind")))
    return cases.withColumnRenamed("source", source).withColumnRenamed("time_ms", time_ms)
