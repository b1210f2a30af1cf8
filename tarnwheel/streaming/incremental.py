"""Incremental forms: cursors, idempotent appends, upserts, decayed counters, event-time windows.

Each runs as a Structured Streaming query. `drain` takes what is there now and ends; the state stays in the
checkpoint, so the next drain goes on from there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import asof, latest, with_previous
from ..session import cut, shared_dir
from ..sources.catalog import Files


def stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path + "*")  # a table may be one file or a folder


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _progress(spark: SparkSession, checkpoint: str | None) -> tuple[str, Callable[[], None]]:
    """(folder of a stream's progress, what to do when it is done): a folder of our own is deleted."""
    if checkpoint:
        return checkpoint, lambda: None
    own = folder_of(spark, "progress")
    return own, lambda: Files(spark, own).delete(own) and None


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs the stream over everything there is now; each micro-batch goes to sink(batch, number). Without a checkpoint of the caller's the next drain begins anew."""
    folder, done = _progress(df.sparkSession, checkpoint)
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    done()


def paced(df: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "500 milliseconds", checkpoint: str | None = None) -> int:
    """Runs the stream with a micro-batch at most `every` so often, until all that is there now is done; the number of batches."""
    seen: list[int] = []

    def counted(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        seen.append(number)

    folder, done = _progress(df.sparkSession, checkpoint)
    q = df.writeStream.foreachBatch(counted).option("checkpointLocation", folder).trigger(processingTime=every).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    done()
    return len(seen)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives by now, as a table in the shared folder: all batches appended, or in complete mode the last."""
    out = folder_of(df.sparkSession, "stream")
    drain(df, lambda b, n: b.write.mode("overwrite" if mode == "complete" else "append").parquet(out), mode)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def append_once(df: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose keys were not there before. With an event time the state is kept for `late` only."""
    return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys) if event_time else df.dropDuplicates(keys)


class Upserts:
    """A table of the newest row per key in a shared folder, in BUCKETS buckets of keys.

    A batch reads and writes only the buckets it touches. Which version of each bucket counts is written down last, in a
    small file for each batch that is created once: a batch that breaks off leaves the state whole, one that comes again
    is passed over, and another object on the same folder goes on from there. Versions that no longer count are deleted.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, schema, key: list[str], order: list[str], folder: str | None = None):
        self.spark, self.schema, self.key, self.order = spark, schema, key, order
        self.folder = folder or folder_of(spark, "upserts")
        self.files = Files(spark, self.folder)

    def _state(self) -> tuple[int, dict[str, str]]:
        """(number of the last batch, version of each bucket)."""
        done = [n for n in self.files.names(f"{self.folder}/_batches") if n.endswith(".json")]
        return (int(done[-1][:-5]), json.loads(self.files.read(f"{self.folder}/_batches/{done[-1]}"))) if done else (-1, {})

    def __call__(self, batch: DataFrame, number: int) -> None:
        last, at = self._state()
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.BUCKETS)).cast("int")
        rows = cut(batch.withColumn("_bucket", bucket))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            old = [f"{self.folder}/{at[str(k)]}/_bucket={k}" for k in touched if str(k) in at]
            if old:
                rows = self._merged(rows.drop("_bucket"), self.spark.read.schema(self.schema).parquet(*old)).withColumn("_bucket", bucket)
            version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
            self._picked(rows).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
            now = {**at, **{str(k): version for k in touched}}
        else:
            now = at
        self.files.create(f"{self.folder}/_batches/{number:012d}.json", json.dumps(now, sort_keys=True))
        for version in set(at.values()) - set(now.values()):
            self.files.delete(f"{self.folder}/{version}")

    def _merged(self, new: DataFrame, old: DataFrame) -> DataFrame:
        return new.unionByName(old)

    def _picked(self, rows: DataFrame) -> DataFrame:
        return latest(rows, [*self.key, "_bucket"], self.order)

    def table(self) -> DataFrame:
        _, at = self._state()
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{v}/_bucket={k}" for k, v in sorted(at.items())))


class _Firsts(Upserts):
    """The first row per key that came."""

    def _merged(self, new: DataFrame, old: DataFrame) -> DataFrame:
        return new.join(old.select(*self.key), self.key, "left_anti").unionByName(old)

    def _picked(self, rows: DataFrame) -> DataFrame:
        return latest(rows, [*self.key, "_bucket"], [c for c in rows.columns if c not in (*self.key, "_bucket")], first=True)


class MetricsSink:
    """A sink with three kinds of writing: newest row per key, first row per key, and every row; one folder each, by batch.

    sink(kind)(batch, number) is what a stream's foreachBatch calls; a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or folder_of(spark, "metrics")

    def upsert(self, name: str, schema, key: list[str], order: list[str]) -> Upserts:
        return Upserts(self.spark, schema, key, order, f"{self.folder}/{name}")

    def ignore(self, name: str, schema, key: list[str]) -> Upserts:
        """Rows whose key is there already are ignored; of those that come together the smallest counts."""
        return _Firsts(self.spark, schema, key, [], f"{self.folder}/{name}")

    def append(self, name: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def appended(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").drop("batch")


class Arrivals:
    """Which tasks are ready, as objects come and go: a task is ready when all its inputs are there, and not ready again when one is removed.

    inputs: (task, object), one row each. A batch has object, present and a time; each object's last state counts. Only the
    tasks of objects in the batch are looked at; newly() gives those that changed, with the batch.
    """

    STATE = "object string, at bigint, present boolean"

    def __init__(self, spark: SparkSession, inputs: DataFrame, folder: str | None = None):
        self.spark, self.inputs = spark, inputs
        self.folder = folder or folder_of(spark, "arrivals")
        self.objects = Upserts(spark, self.STATE, ["object"], ["at", "present"], f"{self.folder}/objects")
        self.tasks = Upserts(spark, "task bigint, batch bigint, n_inputs bigint, n_missing bigint, ready boolean", ["task"], ["batch"], f"{self.folder}/tasks")

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.objects(batch.select("object", "at", "present"), number)
        there = self.objects.table().where("present").select("object", F.lit(True).alias("_there"))
        touched = self.inputs.join(batch.select("object").distinct(), "object", "left_semi").select("task").distinct()
        if number == 0:  # tasks whose inputs no batch names are counted once
            touched = self.inputs.select("task").distinct()
        j = self.inputs.join(touched, "task", "left_semi").join(there, "object", "left")
        now = j.groupBy("task").agg(F.lit(number).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("n_inputs"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
        self.tasks(now.withColumn("ready", F.col("n_missing") == 0), number)

    def table(self) -> DataFrame:
        """(task, batch, n_inputs, n_missing, ready): the state, and the batch at which each task was last looked at."""
        return self.tasks.table()


class Waiting:
    """Waits for objects: `available` as soon as one look finds it so, `never` when it cannot be produced at `confirm` looks in succession."""

    def __init__(self, names: DataFrame, confirm: int = 3):
        self.confirm = confirm
        self.state = cut(names.select("name").distinct().select("name", F.lit("wait").alias("verdict"), F.lit(0).alias("times")))

    def look(self, seen: DataFrame) -> int:
        """seen: (name, verdict: available, wait or never); the number of names that are still waited for."""
        j = self.state.join(seen.select("name", F.col("verdict").alias("_v")), "name", "left")
        settled = F.col("verdict") != "wait"
        times = F.when(settled, F.col("times")).when(F.coalesce("_v", F.lit("never")) == "never", F.col("times") + 1).otherwise(0)
        verdict = F.when(settled, F.col("verdict")).when(F.col("_v") == "available", "available").when(times >= self.confirm, "never").otherwise("wait")
        self.state = cut(j.select("name", verdict.alias("verdict"), times.cast("int").alias("times")))
        return self.state.where("verdict = 'wait'").count()

    def until(self, probe: Callable[[], DataFrame], pause_s: float = 0.5, looks: int = 1000) -> DataFrame:
        """Looks again and again until all is settled; TimeoutError after so many looks."""
        for _ in range(looks):
            if not self.look(probe()):
                return self.state.select("name", "verdict")
            time.sleep(pause_s)
        raise TimeoutError(f"not settled after {looks} looks")


def replayed(log: DataFrame, name: str, order: list[str], added: str, committed: str) -> DataFrame:
    """What a log of additions and removals leaves: the last committed record of each name, if it is an addition."""
    return latest(log.where(committed), [name], [*order, added]).where(added)


class Cursors:
    """Rows newer than each key's cursor; every batch moves the cursors of its keys. Clocks may differ from key to key."""

    def __init__(self, key: str, time: str):
        self.key, self.time = key, time
        self.cursors: DataFrame | None = None

    def take(self, df: DataFrame) -> DataFrame:
        new = df if self.cursors is None else df.join(self.cursors, self.key, "left").where(F.col("cursor").isNull() | (F.col(self.time) > F.col("cursor"))).drop("cursor")
        moved = new.groupBy(self.key).agg(F.max(self.time).alias("cursor"))
        if self.cursors is not None:
            moved = moved.unionByName(self.cursors).groupBy(self.key).agg(F.max("cursor").alias("cursor"))
        self.cursors = moved.checkpoint()
        return new


def decayed_stream(df: DataFrame, key: str, time_s: str, value: str, decay: float) -> DataFrame:
    """(key, last_s, score) after each micro-batch: a sum that loses `decay` of itself a second, kept as state per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(frames).sort_values("t")
        for t, v in zip(rows["t"], rows["v"]):
            t = int(t)
            if last is not None and t > last:
                score *= (1.0 - decay) ** (t - last)
            elif last is not None and t < last:  # late: it has lost its share already
                v = v * (1.0 - decay) ** (last - t)
            score += float(v)
            last = t if last is None else max(t, last)
        state.update((score, last))
        yield pd.DataFrame({"k": [k[0]], "last_s": [last], "score": [score]})

    kind = dict(df.dtypes)[key]
    d = df.select(F.col(key).alias("k"), F.col(time_s).cast("bigint").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    out = d.groupBy("k").applyInPandasWithState(step, f"k {kind}, last_s bigint, score double", "score double, last bigint", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)


def throttled(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """The first row of each key, and then each that comes at least `gap` after the last one kept.

    A row at least `gap` after the row before it is always kept, whatever was kept before, so each run of closer rows is
    thinned by itself: a key's rows are spread over its runs. Only the closer rows go through Python, in order of their runs,
    in batches with any number of runs; neither a run nor a key has to fit into memory.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = last = None
        for b in batches:
            keep = []
            for k, s, t in zip(*(b.column(c).to_pylist() for c in ("k", "s", "t"))):
                if run != (k, s):
                    run, last = (k, s), s
                if t - last >= gap:
                    last = t
                    keep.append(True)
                else:
                    keep.append(False)
            yield b.select(["k", "t"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(df.dtypes)
    d = df.select(F.col(key).alias("k"), F.col(time).alias("t")).where("k is not null and t is not null").distinct()
    d = cut(with_previous(d, "k", "t", ["t"]))
    far = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") >= gap)
    close = d.where(~far)
    # a run starts at the row before a closer one that is not close itself
    starts = close.select("k", F.col("prev_t").alias("s")).join(close.select("k", F.col("t").alias("s")), ["k", "s"], "left_anti")
    runs = asof(close.select("k", "t"), starts, "k", "t", "s", ["s"]).select("k", F.col("asof_s").alias("s"), "t")
    thinned = runs.repartition("k", "s").sortWithinPartitions("k", "s", "t").mapInArrow(thin, f"k {kind[key]}, t {kind[time]}")
    return d.where(far).select("k", "t").unionByName(thinned).withColumnRenamed("k", key).withColumnRenamed("t", time)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, keys, n, total) per window of event time; `slide` makes the windows overlap, `late` drops what comes later than that."""
    d = df.withWatermark(time, late) if late else df
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return d.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """(start, keys, n) per session: rows of a key that follow each other within the gap."""
    d = df.withWatermark(time, late) if late else df
    return d.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
