"""References to keys that a parent table lacks, or holds only at another time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small

#: Keys of one block of the key space, as a power of two; runs are cut at block edges.
BLOCK_BITS = 20
#: The verdicts on the referenced keys are broadcast up to this many rows (about 40 bytes each).
MAX_BROADCAST_ROWS = 500_000


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """(block, run_start, run_end): the distinct keys as contiguous runs, cut at the edges of blocks of 2**BLOCK_BITS keys.

    A window holds one block, so at most 2**BLOCK_BITS keys, however many parents there are.
    """
    k = parents.select(F.col(key).cast("bigint").alias("k")).where("k is not null").distinct().withColumn("block", F.shiftright("k", BLOCK_BITS))
    w = Window.partitionBy("block").orderBy("k")
    return (
        k.withColumn("island", F.col("k") - F.row_number().over(w))
        .groupBy("block", "island").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def beyond_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """keys (k) with `missing`: as-of match to the run that starts at or before k in k's block, and k lies beyond its end."""
    a = runs.select("block", F.col("run_start").alias("k"), F.lit(0).alias("side"), "run_end")
    b = keys.select(F.shiftright("k", BLOCK_BITS).alias("block"), "k", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("run_end"))
    w = Window.partitionBy("block").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        a.unionByName(b).withColumn("reach", F.last("run_end", ignorenulls=True).over(w)).where("side = 1")
        .select("k", (F.col("reach").isNull() | (F.col("k") > F.col("reach"))).alias("missing"))
    )


def utc_day(ms: Column) -> Column:
    """The UTC day of epoch milliseconds as YYYY-MM-DD, whatever the session's time zone; null beyond the calendar."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).try_cast("int")).cast("string")


def orphans(refs: DataFrame, parents: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(ref_table, period, key, ref_id, kind) for references that no parent covers.

    refs: ref_table, key, ref_id, time_ms; parents: key, from_ms, to_ms (null: still there). kind is `missing`
    (no parent has the key), else `early` (time before from_ms), else `gone` (time after to_ms). Rows with a null
    key or time are no references. Repeated references count once. A key that several parent rows hold is
    covered from the earliest from_ms; it is gone only if each row has a to_ms, and then after the latest.
    With no parents all is missing. Other columns of either side are never read.

    References are first reduced to their distinct keys where they are read, so a key with a third of all rows
    costs one row; only those keys are matched with the runs. The verdicts are then joined back: broadcast up
    to max_broadcast_rows, else by a shuffled join, in which AQE splits a hot key's partition.
    """
    r = refs.select("ref_table", F.col("key").cast("bigint").alias("k"), "ref_id", F.col("time_ms").cast("bigint").alias("time_ms")).where("k is not null and time_ms is not null")
    p = parents.select(F.col("key").cast("bigint").alias("k"), F.col("from_ms").cast("bigint").alias("from_ms"), F.col("to_ms").cast("bigint").alias("to_ms"))
    missing = beyond_runs(r.select("k").distinct(), key_runs(p, "k"))
    spans = p.where("k is not null").groupBy("k").agg(
        F.min("from_ms").alias("from_ms"), F.when(F.count("to_ms") == F.count(F.lit(1)), F.max("to_ms")).alias("to_ms")
    )
    verdict = missing.join(spans, "k", "left").where("missing or from_ms is not null or to_ms is not null")
    verdict, _ = broadcast_if_small(verdict, max_broadcast_rows)
    kind = F.when(F.col("missing"), "missing").when(F.col("time_ms") < F.col("from_ms"), "early").when(F.col("time_ms") > F.col("to_ms"), "gone")
    return (
        r.join(verdict, "k").withColumn("kind", kind).where("kind is not null")
        .select("ref_table", utc_day(F.col("time_ms")).alias("period"), F.col("k").alias("key"), "ref_id", "kind").distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """References per table, period and kind, with the number of distinct keys."""
    return found.groupBy("ref_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))


