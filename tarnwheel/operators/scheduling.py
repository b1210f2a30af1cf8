"""Which worker takes a task: capabilities first, then local data, then anyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .locality import most_local


def capability_matches(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """(needs, worker, matched, size): how many of each distinct set of needs a worker has, of those who have any.

    tasks: needs (sorted array of strings); workers: worker, has (array). Sets of needs are few beside the tasks, and meet
    the workers by an equi join on the single capability.
    """
    sets = tasks.select("needs").distinct().withColumn("size", F.size("needs"))
    offers = workers.select("worker", F.explode("has").alias("cap")).distinct()
    return sets.select("needs", "size", F.explode("needs").alias("cap")).join(offers, "cap").groupBy("needs", "worker").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.any_value("size").alias("size"))


def choose_workers(tasks: DataFrame, workers: DataFrame, local: DataFrame | None = None, reads: DataFrame | None = None, holders: DataFrame | None = None) -> DataFrame:
    """(task, worker, how): `full` the first idle worker with all capabilities; else, for tasks that need not wait any longer,
    `local` the one with most local bytes among those with the most capabilities, or `degraded` the first idle of these; else `wait`.

    tasks: task, needs (array of strings), may_degrade (boolean); workers: worker, has (array), idle_order; local: task, worker,
    bytes, or instead of it reads: task, object and holders: object, worker, bytes (as for locality.local_bytes), of which only what
    tasks without a full match read is added up. Without needs every worker matches in full; a task whose needs nobody has in part takes from all workers when it
    degrades. Ties go to the smaller idle_order, then worker. Only sets of needs meet workers, and tasks only the workers that hold their data.
    """
    t = tasks.withColumn("needs", F.array_sort(F.array_distinct(F.coalesce("needs", F.array().cast("array<string>")))))
    m = capability_matches(t, workers)
    order = F.struct("idle_order", "worker")
    first_of_all = workers.agg(F.min(order).alias("anyone"))
    held = m.join(workers.select("worker", "idle_order"), "worker").groupBy("needs").agg(F.min(F.when(F.col("matched") == F.col("size"), order)).alias("full"), F.max("matched").alias("best"), F.min(F.struct((-F.col("matched")).alias("m"), "idle_order", "worker")).alias("most"))
    sets = t.select("needs").distinct().join(held, "needs", "left").crossJoin(F.broadcast(first_of_all))  # one row
    sets = sets.withColumn("full", F.when(F.size("needs") == 0, F.col("anyone")).otherwise(F.col("full")))

    def fit(df: DataFrame) -> DataFrame:
        """Rows whose worker has the most capabilities of those needed; without any, all are alike."""
        ranked = df.join(m.select("needs", "worker", "matched"), ["needs", "worker"], "left").join(sets.select("needs", "best"), "needs")
        return ranked.where(F.coalesce("matched", F.lit(0)) == F.coalesce("best", F.lit(0)))

    if local is not None:
        near = fit(local.join(t.select("task", "needs"), "task")).where("bytes > 0").groupBy("task").agg(F.min(F.struct((-F.col("bytes")).alias("b"), "worker")).alias("near"))
    else:
        rest = t.join(sets, "needs").where(F.col("full").isNull() & F.coalesce("may_degrade", F.lit(False))).select("task", "needs").distinct()
        near = most_local(rest, fit, reads, holders)
    j = t.join(sets, "needs").join(near, "task", "left")
    degraded = F.coalesce(F.col("most.worker"), F.col("anyone.worker"))
    how = F.when(F.col("full").isNotNull(), "full").when(~F.coalesce("may_degrade", F.lit(False)), "wait").when(F.col("near").isNotNull(), "local").when(degraded.isNotNull(), "degraded").otherwise("wait")
    worker = F.when(how == "full", F.col("full.worker")).when(how == "local", F.col("near.worker")).when(how == "degraded", degraded)
    return j.select("task", worker.alias("worker"), how.alias("how"))
