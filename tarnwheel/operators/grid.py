"""Irregular readings of running counters onto a regular grid, with missing cells filled by a low-rank model.

Readings are first reduced to one row per (source, slot). Sources are hashed into blocks and time is cut into
days; one Arrow group is a block's day, a source-by-time matrix of bounded size, with the slots within `reach` of
the day's edges in both days. In it, the growth per slot (log scale, each source against its own mean) is
factorised by alternating least squares over the observed cells. Observed cells stay exact; an empty slot between
two readings is filled from the factors; a cell whose source or slot has too few observed cells stays marked. A slot
needs one observed cell, unless the source is alone in its block: then there is no pattern but its own pace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Sources of a block; a matrix has at most this many rows on average, and a day's slots as columns.
SOURCES_PER_BLOCK = 64
SERIES = "source bigint, slot_ms bigint, state string, value double, n_slots bigint, gap_ms bigint"


def als(x: np.ndarray, seen: np.ndarray, rank: int = 2, rounds: int = 20, ridge: float = 1.0, still: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Factors (u, v) with x close to u @ v.T on the seen cells, by alternating ridge regressions.

    It ends when a round lowers the ridge objective by less than the share `still`, at the latest after `rounds`.
    Deterministic: v starts from cosines. Rows or columns without seen cells get zeros.
    """
    m, n = x.shape
    w, y = seen.astype(float), np.where(seen, x, 0.0)
    v = np.stack([np.cos(np.pi * k * (np.arange(n) + 0.5) / n) for k in range(rank)], 1)
    eye = ridge * np.eye(rank)

    def solve(f: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        outer = (f[:, :, None] * f[:, None, :]).reshape(len(f), -1)
        gram = (w @ outer).reshape(-1, rank, rank) + eye
        return np.linalg.solve(gram, (y @ f)[:, :, None])[:, :, 0]

    u, was = np.zeros((m, rank)), np.inf
    for _ in range(rounds):
        u = solve(v, w, y)
        v = solve(u, w.T, y.T)
        now = float((w * (y - u @ v.T) ** 2).sum() + ridge * ((u * u).sum() + (v * v).sum()))
        if was - now <= still * now:
            break
        was = now
    return u, v


def _block(slot: int, max_gap_ms: int, rank: int, support: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        day = int(key[0])
        g = g.sort_values(["source", "slot"], kind="stable")
        src, at = g["source"].to_numpy(), g["slot"].to_numpy()
        val, lo, hi = g["value"].to_numpy(float), g["first_ms"].to_numpy(), g["last_ms"].to_numpy()
        row = np.cumsum(np.r_[True, src[1:] != src[:-1]]) - 1
        base, names = at.min(), src[np.r_[True, src[1:] != src[:-1]]]
        m, n = len(names), int(at.max() - base + 1)
        nxt = np.flatnonzero(src[1:] == src[:-1])
        step, growth = at[nxt + 1] - at[nxt], val[nxt + 1] - val[nxt]
        gap = lo[nxt + 1] - hi[nxt]
        x, seen = np.zeros((m, n)), np.zeros((m, n), bool)
        c = nxt[(step == 1) & (growth >= 0)]
        x[row[c], at[c] + 1 - base] = np.log1p(val[c + 1] - val[c])
        seen[row[c], at[c] + 1 - base] = True
        mean = np.where(seen.any(1), x.sum(1) / np.maximum(seen.sum(1), 1), 0.0)
        u, v = als(x - mean[:, None], seen, rank)
        known, backed = seen.sum(1) >= support, (seen.sum(0) > 0) | (m == 1)
        out = [pd.DataFrame({"source": src, "slot_ms": at * slot, "state": "observed", "value": val, "n_slots": 1, "gap_ms": 0})]
        holes = np.flatnonzero((step > 1) & (gap <= max_gap_ms))
        if len(holes):
            i, k = nxt[holes], step[holes]
            h = np.repeat(np.arange(len(holes)), k)  # the empty slots and the one that ends the gap
            j = np.arange(len(h)) - np.repeat(np.cumsum(k) - k, k)
            r, col = row[i][h], at[i][h] + 1 + j - base
            rate = np.expm1(np.clip((u[r] * v[col]).sum(1) + mean[r], 0, 60))
            total = np.bincount(h, rate)
            run_sum = np.cumsum(rate) - np.repeat(np.r_[0, np.cumsum(total)[:-1]], k)
            grown = growth[holes][h]
            share = np.where(total[h] > 0, run_sum / np.maximum(total[h], 1e-300), (j + 1) / k[h])
            filled = np.where(grown >= 0, val[i][h] + grown * share, val[i][h] + run_sum)  # after a restart the source's own pace goes on
            ok, empty = known[r] & backed[col], j + 1 < k[h]
            out.append(pd.DataFrame({"source": src[i][h], "slot_ms": (at[i][h] + 1 + j) * slot, "state": np.where(ok, "filled", "marked"), "value": np.where(ok, filled, np.nan), "n_slots": 1, "gap_ms": gap[holes][h]})[empty])
        res = pd.concat(out)
        res = res[res["slot_ms"] // DAY_MS == day]
        res["value"] = res["value"].astype(object).where(res["value"].notna(), None)
        return res

    return run


def slots(df: DataFrame, source: str, time_ms: str, value: str, slot_ms: int) -> DataFrame:
    """(source, slot, first_ms, last_ms, value): usable readings per slot; value is the latest, of equally late ones the largest."""
    t = df.select(F.col(source).cast("bigint").alias("source"), F.col(time_ms).cast("bigint").alias("t"), F.col(value).cast("bigint").alias("v"))
    t = t.where("source is not null and t is not null and v >= 0")
    return t.groupBy("source", F.floor(F.col("t") / slot_ms).alias("slot")).agg(F.min("t").alias("first_ms"), F.max("t").alias("last_ms"), F.max(F.struct("t", "v")).getField("v").alias("value"))


def regular_series(
    df: DataFrame, source: str, time_ms: str, value: str, slot_ms: int = 60_000, max_gap_ms: int = 7_200_000, rank: int = 2, support: int = 8, pauses: bool = True
) -> DataFrame:
    """(source, slot_ms, state, value, n_slots, gap_ms): a regular series of a running counter per source.

    state `observed`: the slot's latest usable reading (not null, not negative), exact. `filled` and `marked`: an
    empty slot between two successive usable readings at most max_gap_ms apart; gap_ms is that distance. It is
    filled from the low-rank model, within the growth between the two readings where there is any; it is marked
    (value null) if the source has fewer than `support` observed steps in that day, or if there are other sources and none of
    the block has an observed step into that slot. `pause` (only with pauses): one
    row for a longer gap, from its first empty slot on, n_slots slots long, value null.
    Rows with a null source or time are passed over; repeated rows change nothing; a single reading gives its slot;
    an empty table gives an empty result. slot_ms must divide a day.
    """
    if DAY_MS % slot_ms:
        raise ValueError("slot_ms must divide a day")
    s = slots(df, source, time_ms, value, slot_ms)
    per_day, reach = DAY_MS // slot_ms, max_gap_ms // slot_ms + 2
    n = df.agg(F.approx_count_distinct(source)).first()[0]
    blocks = max(1, round(n / SOURCES_PER_BLOCK))
    wide = s.withColumn("day", F.explode(F.sequence(F.floor((F.col("slot") - reach) / per_day), F.floor((F.col("slot") + reach) / per_day)))).withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)))
    res = wide.groupBy("day", "block").applyInPandas(_block(slot_ms, max_gap_ms, rank, support), SERIES)
    if pauses:
        days = s.groupBy("source", F.floor(F.col("slot") / per_day).alias("day")).agg(F.min(F.struct("slot", "first_ms")).alias("a"), F.max(F.struct("slot", "last_ms")).alias("z"))
        w = Window.partitionBy("source").orderBy("day")
        over_night = days.withColumn("b", F.lead("a").over(w)).select("source", F.col("z.slot").alias("f"), F.col("z.last_ms").alias("ft"), F.col("b.slot").alias("t"), F.col("b.first_ms").alias("tt"))
        wd = Window.partitionBy("source", F.floor(F.col("slot") / per_day)).orderBy("slot")
        by_day = s.withColumn("t", F.lead("slot").over(wd)).withColumn("tt", F.lead("first_ms").over(wd)).select("source", F.col("slot").alias("f"), F.col("last_ms").alias("ft"), "t", "tt")
        long = over_night.unionByName(by_day).withColumn("gap", F.try_subtract("tt", "ft")).where((F.col("gap") > max_gap_ms) & (F.col("t") - F.col("f") > 1))
        res = res.unionByName(
            long.select("source", ((F.col("f") + 1) * slot_ms).alias("slot_ms"), F.lit("pause").alias("state"), F.lit(None).cast("double").alias("value"), (F.col("t") - F.col("f") - 1).alias("n_slots"), F.col("gap").alias("gap_ms"))
        )
    return res.withColumnRenamed("source", source)
