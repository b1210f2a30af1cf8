"""The pN_ queries of the core problems, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import regular_series
from ..operators.intervals import periods_and_gaps
from ..operators.references import orphan_report, orphans
from ..operators.spikes import filler, wrong_readings
from ..session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _wrong(spark: SparkSession, d: str) -> DataFrame:
    rss, cpu, load = (F.col(c) for c in ("proc_rss_bytes", "host_cpu_bps", "host_load1_x100"))
    impossible = {
        "proc_rss_bytes": (rss <= 0) | filler(rss) | (rss > F.col("host_mem_total_bytes")),
        "host_cpu_bps": (cpu < 0) | (cpu > 10_000),
        "host_load1_x100": (load < 0) | filler(load),
    }
    return wrong_readings(table(spark, d, "worker_samples", "worker_id", "epoch_ms", *impossible, "host_mem_total_bytes"), "worker_id", "epoch_ms", impossible)


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _wrong(spark, d).select("worker_id", "epoch_ms", "metric").distinct()


@query()
def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _wrong(spark, d).groupBy("worker_id", "metric", "kind").agg(F.count(F.lit(1)).alias("n"))


MAX_PAUSE_MS = 7_200_000
USABLE = "worker_id > 0 and exec_start_ms > 0 and exec_end_ms > exec_start_ms"
PERIODS_SQL = f"""
with t as (select distinct worker_id w, exec_start_ms s, exec_end_ms e from tasks where {USABLE}),
m as (select *, max(e) over (partition by w order by s, e rows between unbounded preceding and 1 preceding) reach from t),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by w order by s, e) island from m),
p as (select w, island, min(s) a, max(e) z from i group by w, island),
n as (select *, lead(a) over (partition by w order by a) nxt from p)
"""


def _busy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks", "worker_id", "exec_start_ms", "exec_end_ms").where(USABLE)


@query(f"""{PERIODS_SQL}
select w as worker_id, 'period' as kind, a as start_ms, z as end_ms from n
union all select w, 'gap', z, nxt from n where nxt - z <= {MAX_PAUSE_MS}""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(_busy(spark, d), "worker_id", "exec_start_ms", "exec_end_ms", MAX_PAUSE_MS)


@query(f"""{PERIODS_SQL}, x as (select w, 'period' k, z - a ms from n union all select w, 'gap', nxt - z from n where nxt - z <= {MAX_PAUSE_MS})
select w as worker_id, k as kind, count(*) as n, cast(sum(ms) as bigint) as total_ms, max(ms) as longest_ms from x group by w, k""")
def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("end_ms") - F.col("start_ms")
    return p2_found(spark, d).groupBy("worker_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest_ms"))


ORPHANS_SQL = """
with w as (select worker_id k, min(first_seen_ms) f, case when count(*) = count(case when last_event in ('DEAD', 'EXITED') then last_event_ms end) then max(last_event_ms) end z
           from workers where worker_id is not null group by worker_id),
r as (select 'tasks' t, worker_id k, task_id id, started_ms ms from tasks where worker_id > 0 and started_ms is not null
      union select 'worker_samples', worker_id, epoch_ms, epoch_ms from worker_samples where worker_id is not null and epoch_ms is not null),
v as (select r.*, case when w.k is null then 'missing' when ms < f then 'early' when ms > z then 'gone' end kind from r left join w on r.k = w.k),
o as (select distinct t as ref_table, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as period, k as worker_id, id as ref_id, kind from v where kind is not null)
"""


@query(ORPHANS_SQL + "select * from o")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks", "task_id", "worker_id", "started_ms").where("worker_id > 0 and started_ms is not null")
    samples = table(spark, d, "worker_samples", "worker_id", "epoch_ms")
    refs = tasks.select(F.lit("tasks").alias("ref_table"), F.col("worker_id").alias("key"), F.col("task_id").alias("ref_id"), F.col("started_ms").alias("time_ms")).unionByName(
        samples.select(F.lit("worker_samples").alias("ref_table"), F.col("worker_id").alias("key"), F.col("epoch_ms").alias("ref_id"), F.col("epoch_ms").alias("time_ms"))
    )
    closed = F.when(F.col("last_event").isin("DEAD", "EXITED"), F.col("last_event_ms"))
    workers = table(spark, d, "workers", "worker_id", "first_seen_ms", "last_event_ms", "last_event").select(F.col("worker_id").alias("key"), F.col("first_seen_ms").alias("from_ms"), closed.alias("to_ms"))
    return orphans(refs, workers).withColumnRenamed("key", "worker_id")


@query(ORPHANS_SQL + "select ref_table, period, kind, count(*) as n_refs, count(distinct worker_id) as n_keys from o group by ref_table, period, kind")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p4_found(spark, d).withColumnRenamed("worker_id", "key"))


SLOT_MS = 60_000
SLOTS_SQL = f"""
with r as (select distinct worker_id w, epoch_ms t from worker_samples where net_read_bytes >= 0 and worker_id is not null and epoch_ms is not null),
n as (select w, t, lead(t) over (partition by w order by t) u from r),
g as (select w, t, u, t // {SLOT_MS} a, u // {SLOT_MS} b from n)
"""


def _series(spark: SparkSession, d: str, pauses: bool) -> DataFrame:
    return regular_series(table(spark, d, "worker_samples", "worker_id", "epoch_ms", "net_read_bytes"), "worker_id", "epoch_ms", "net_read_bytes", SLOT_MS, MAX_PAUSE_MS, pauses=pauses)


@query(f"""{SLOTS_SQL}
select w as worker_id, unnest(generate_series(a + 1, b - 1)) * {SLOT_MS} as slot_ms from g where u - t <= {MAX_PAUSE_MS} and b - a > 1""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, False).where("state in ('filled', 'marked')").select("worker_id", "slot_ms")


@query(f"""{SLOTS_SQL}
select w as worker_id, a * {SLOT_MS} as slot_ms, case when min(x) = 0 then 'observed' when min(x) = 1 then 'empty' else 'pause' end as state, max(k) as n_slots
from (select w, a, 0 x, 1 k from g union all select w, unnest(generate_series(a + 1, b - 1)), 1, 1 from g where u - t <= {MAX_PAUSE_MS} and b - a > 1
      union all select w, a + 1, 2, b - a - 1 from g where u - t > {MAX_PAUSE_MS} and b - a > 1) group by w, a""")
def p6_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("state").isin("filled", "marked"), "empty").otherwise(F.col("state"))
    return _series(spark, d, True).select("worker_id", "slot_ms", state.alias("state"), "n_slots")


@query()
def p6_series(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, True)
