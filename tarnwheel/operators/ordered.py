"""Latest rows, earlier rows, carried values and rates of time-ordered tables.

A key may hold a third of all rows, so nothing here sorts a key's whole history in one task: the latest row is an
aggregate with partial sums, and whatever looks back does so within (key, time shard), with each shard's last row
handed to the next one in a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, one_row

SHARD_MS = 86_400_000


def latest(df: DataFrame, key: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key: the last (or first) in `order`. Ties in order fall to the largest (smallest) whole row."""
    pick = F.min if first else F.max
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    return df.groupBy(*key).agg(pick(row).alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest))


def with_latest(entities: DataFrame, samples: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """entities with the named columns of each one's latest sample; null where there is none."""
    return entities.join(latest(samples.select(key, *order, *(c for c in columns if c not in order)), [key], order).select(key, *columns), key, "left")


def with_previous(df: DataFrame, key: str, time: str, columns: list[str], shard: int = SHARD_MS) -> DataFrame:
    """df with prev_<column>: the values of the same key's row before, in order of time; null at the first.

    Rows of one key and time are ordered by the columns.
    """
    d = df.withColumn("_s", F.floor(F.col(time) / shard))
    w = Window.partitionBy(key, "_s").orderBy(time, *columns)
    row = F.struct(time, *(c for c in columns if c != time))
    ends = d.groupBy(key, "_s").agg(F.max(row).alias("_e")).withColumn("_b", F.lag("_e").over(Window.partitionBy(key).orderBy("_s"))).select(key, "_s", "_b")
    d = d.withColumn("_p", F.lag(row).over(w)).join(ends, [key, "_s"])
    prev = F.coalesce("_p", "_b")
    return d.select(*df.columns, *(prev.getField(c).alias(f"prev_{c}") for c in columns))


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], max_age: int | None = None, shard: int = SHARD_MS) -> DataFrame:
    """left with asof_<column> of the key's latest right row at or before left_time; null where there is none.

    columns are of the right side and may include right_time. Of right rows with one time the largest in order of the columns
    counts. max_age: an older match is none. Left rows with a null key or time match nothing; every left row comes out once.

    Rows meet within (key, time shard); what a shard starts with is the last right row of an earlier shard, found in the
    table of the shards' last rows. A key's whole history is never in one task.
    """
    take = [right_time, *(c for c in columns if c != right_time)]
    r = right.select(F.col(key).alias("_k"), F.struct(*take).alias("_r")).where(F.col("_k").isNotNull() & F.col(f"_r.`{right_time}`").isNotNull())
    r = r.withColumn("_t", F.col(f"_r.`{right_time}`")).withColumn("_s", F.floor(F.col("_t") / shard))
    l = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l")).withColumn("_s", F.floor(F.col("_t") / shard))
    tails = r.groupBy("_k", "_s").agg(F.max("_r").alias("_e"))
    seen = tails.unionByName(l.select("_k", "_s").distinct().withColumn("_e", F.lit(None).cast(tails.schema["_e"].dataType))).groupBy("_k", "_s").agg(F.max("_e").alias("_e"))
    before = seen.withColumn("_b", F.last("_e", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    both = r.select("_k", "_s", "_t", "_r", F.lit(None).cast(l.schema["_l"].dataType).alias("_l")).unionByName(l.select("_k", "_s", "_t", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_l"))
    w = Window.partitionBy("_k", "_s").orderBy(F.asc("_t"), F.asc_nulls_last("_r")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).where("_l is not null").join(before, ["_k", "_s"], "left")
    hit = F.coalesce("_in", "_b")
    if max_age is not None:
        hit = F.when(F.col("_t") - hit.getField(right_time) <= max_age, hit)
    return found.withColumn("_h", hit).select(*(F.col(f"_l.`{c}`").alias(c) for c in left.columns), *(F.col(f"_h.`{c}`").alias(f"asof_{c}") for c in columns))


def rates(df: DataFrame, key: str, time_ms: str, counter: str) -> DataFrame:
    """df with `rate` per second: growth since the row before over the time between, 0 after a restart, one decimal; null at the first."""
    d = with_previous(df, key, time_ms, [time_ms, counter])
    dt = (F.col(time_ms) - F.col(f"prev_{time_ms}")) / 1000.0
    up = F.greatest(F.col(counter) - F.col(f"prev_{counter}"), F.lit(0))
    return d.withColumn("rate", F.when(dt > 0, F.round(up / dt, 1))).drop(f"prev_{time_ms}", f"prev_{counter}")


def bucketed(df: DataFrame, key: str, time_ms: str, columns: list[str], bucket_ms: int) -> DataFrame:
    """(key, bucket, columns): the last sample of each key in each bucket."""
    d = df.select(key, time_ms, *columns, F.floor(F.col(time_ms) / bucket_ms).alias("bucket"))
    return latest(d, [key, "bucket"], [time_ms]).drop(time_ms)


def carried(df: DataFrame, key: str, time_ms: str, columns: list[str], bucket_ms: int) -> DataFrame:
    """(key, bucket, columns, fresh): last samples per bucket, carried forward over buckets in which any key has one.

    No value before a key's first sample. Work grows with the cells that come out.
    """
    b = bucketed(df, key, time_ms, columns, bucket_ms)
    n = cut(dense_ids(b.select("bucket").distinct(), ["bucket"], "no", 1).withColumn("no", F.col("no").cast("int")))
    runs = b.join(n, "bucket")
    last = n.agg(F.max("no").alias("_z"))
    runs = runs.withColumn("_n", F.lead("no").over(Window.partitionBy(key).orderBy("no"))).crossJoin(one_row(last))
    cells = runs.withColumn("no2", F.explode(F.sequence("no", F.coalesce(F.col("_n") - 1, F.col("_z")))))
    return cells.select(key, "no2", *columns, (F.col("no") == F.col("no2")).alias("fresh")).join(n.withColumnRenamed("no", "no2"), "no2").drop("no2")


def totals_at_ticks(df: DataFrame, key: str, time_ms: str, value: str, tick_ms: int, ends: DataFrame | None = None, drop_before_end: bool = False) -> DataFrame:
    """(tick, total): at each whole tick, the sum over keys of the latest positive value at or before it.

    ends: (key, end_ms) of keys that died. By default a key's value no longer counts at ticks from its end on, unless a later
    sample revives it; with drop_before_end samples up to the end never count, not even at earlier ticks.
    Each sample adds its growth over the sample before, so ticks and keys are never multiplied: the samples are
    reduced to one per key and tick, and the running sum goes over the ticks alone.
    """
    d = df.where(F.col(value) > 0).select(F.col(key).alias("k"), F.col(time_ms).alias("t"), F.col(value).alias("v"), F.lit(0).alias("off"))
    if ends is not None:
        e = ends.select(F.col(key).alias("k"), F.col("end_ms").alias("e"))
        if drop_before_end:
            d = d.join(e, "k", "left").where("e is null or t > e").drop("e")
        else:
            d = d.unionByName(e.join(d.select("k").distinct(), "k", "left_semi").select("k", F.col("e").alias("t"), F.lit(0).cast("bigint").alias("v"), F.lit(1).alias("off")))
    d = d.withColumn("tick", F.ceil(F.col("t") / tick_ms).cast("bigint"))
    d = latest(d, ["k", "tick"], ["t", "off", "v"])
    grown = d.withColumn("dv", F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("k").orderBy("tick")), F.lit(0)))
    per = grown.groupBy("tick").agg(F.sum("dv").alias("dv"))
    return running_sums(per, "tick", ["dv"]).select((F.col("tick") * tick_ms).alias("tick"), (F.col("dv_before") + F.col("dv")).alias("total"))


def window_stats(df: DataFrame, time: str, value: str, lo: Column, hi: Column) -> list[Column]:
    """Aggregates avg (whole number) and peak of the values with lo <= time <= hi; null without any."""
    v = F.when(F.col(time).between(lo, hi), F.col(value))
    return [F.floor(F.sum(v) / F.count(v)).cast("bigint").alias("avg"), F.max(v).alias("peak")]


def phases(df: DataFrame, time: str, value: str, n: int = 10) -> DataFrame:
    """(phase, lo, hi, avg, peak): n equal stretches from 0 to the last time, one if there are fewer than n samples."""
    span = df.agg(F.max(time).alias("dur"), F.count(F.lit(1)).alias("m"))
    p = span.withColumn("k", F.when(F.col("m") < n, 1).otherwise(n)).where("m > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    p = p.select((F.col("i") + 1).alias("phase"), F.expr("dur * i div k").alias("lo"), F.expr("case when i = k - 1 then dur else dur * (i + 1) div k - 1 end").alias("hi"))
    spans = p.agg(F.array_sort(F.collect_list(F.struct("phase", "lo", "hi"))).alias("_p"))  # at most n of them
    x = df.select(F.col(time).alias("_t"), F.col(value).alias("_v")).crossJoin(one_row(spans))
    at = F.get(F.filter("_p", lambda s: (s["lo"] <= F.col("_t")) & (F.col("_t") <= s["hi"])), F.lit(0))["phase"]
    per = x.groupBy(at.alias("phase")).agg(F.floor(F.sum("_v") / F.count("_v")).cast("bigint").alias("avg"), F.max("_v").alias("peak"))
    return p.join(per, "phase", "left").select("phase", "lo", "hi", "avg", "peak")


def quota(df: DataFrame, key: str, order: list[str], limit: Column, salts: int = 16) -> DataFrame:
    """The first `limit` rows of each key in order; a limit below 0 keeps all, a null limit none.

    Rows without a limit are not put in order. The others are thinned in `salts` parts of each key first, so a hot key is spread.
    """
    d = df.withColumn("_l", limit)
    first = d.where("_l >= 0").withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    for by in ([key, "_s"], [key]):
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n <= _l")
    return d.where("_l < 0").select(*df.columns).unionByName(first.select(*df.columns))


def decayed(df: DataFrame, key: str, time_s: str, columns: list[str], decay: float, shard_s: int = 3600) -> DataFrame:
    """(key, last_s, columns): sums in which each row loses `decay` of its weight a second up to the key's last row.

    Rows are summed per (key, hour) as of the hour's end, then the hours as of the last row.
    """
    keep = 1.0 - decay
    d = df.withColumn("_h", (F.floor(F.col(time_s) / shard_s) + 1) * shard_s)
    w = F.pow(F.lit(keep), F.col("_h") - F.col(time_s))
    part = d.groupBy(key, "_h").agg(F.max(time_s).alias("_t"), *(F.sum(F.col(c) * w).alias(c) for c in columns))
    part = part.withColumn("last_s", F.max("_t").over(Window.partitionBy(key)))
    back = F.pow(F.lit(keep), F.col("last_s") - F.col("_h"))
    return part.groupBy(key, "last_s").agg(*(F.sum(F.col(c) * back).alias(c) for c in columns))


def prefix_cuts(load: DataFrame, index: str, value: str, n: int) -> DataFrame:
    """(k, cut): n + 1 cuts of a load profile so that each part holds about an equal share.

    Cut k lies at the right edge of the first bin at which the running sum, with a tolerance of 1e-9 of the total,
    reaches k/n; cut 0 is 0, cut n the number of bins; later cuts that no bin reaches lie there too. The profile is a
    marginal of a grid, so one ordered pass is enough.
    """
    w = Window.orderBy(index)
    c = load.select(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    run = c.withColumn("acc", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tot = c.agg(F.sum("v").alias("total"), (F.max("i") + 1).alias("m"))
    ks = tot.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    # the shares that the running sum has reached at each bin; the bin where a share is reached first has its cut
    hit = run.crossJoin(one_row(tot)).where("total > 0").withColumn("hi", F.least(F.floor((F.col("acc") + F.col("total") * 1e-9) * n / F.col("total")).cast("int"), F.lit(n - 1)))
    hit = hit.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0))).where("hi > lo")
    at = hit.select(F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("k"), (F.col("i") + 1).alias("at"))
    return ks.join(at, "k", "left").select("k", F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == n, F.col("m")).otherwise(F.coalesce("at", "m")).cast("bigint").alias("cut"))


def running_before(df: DataFrame, order: list[str], value: str, partition: list[str] | None = None) -> DataFrame:
    """df with `before`: the sum of the values ahead of the row in order."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


#: Numbers of a block in which running sums are made, as a power of two.
SUM_BITS = 16


def running_sums(df: DataFrame, order: str, columns: list[str], bits: int = SUM_BITS) -> DataFrame:
    """df with <column>_before: the sum of a column over all rows before, in order of a whole number.

    Sums are made inside blocks of 2**bits successive numbers; only one row a block goes through a window over all.
    """
    d = df.withColumn("_b", F.shiftright(order, bits))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_b").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(columns)))
    ahead = totals.select("_b", *(F.coalesce(F.sum(f"_t{i}").over(w), F.lit(0)).alias(f"_a{i}") for i in range(len(columns))))
    sums = [(F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in columns]
    d = d.select("*", *sums).join(ahead, "_b")
    return d.select(*df.columns, *((F.col(f"{c}_before") + F.col(f"_a{i}")).alias(f"{c}_before") for i, c in enumerate(columns)))


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0, shards: int | None = None) -> DataFrame:
    """df with consecutive ids in order, from start.

    Ranges of the order are numbered apart and shifted by the rows in the ranges before them, so no task sorts all rows.
    """
    n = shards or df.sparkSession.sparkContext.defaultParallelism
    d = cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))  # fixed, so that both uses see one division
    local = d.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = running_before(sizes, ["_p"], "_c").select("_p", "before")
    joined = local.join(F.broadcast(before), "_p")  # one row for each of the n ranges
    return joined.withColumn(name, F.col("before") + F.col("_n") - 1 + start).drop("_p", "_n", "before")
