"""Run analytics over the metrics tables: filters, latest rows, pages, carried values, rates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import filters as P
from ..operators import ordered as O
from ..session import broadcast_if_small, one_row, table
from .base import Register

R = Register()
QUERIES, SQL = R.queries, R.sql
T, W, SA, IO = "tasks", "workers", "worker_samples", "object_io"
DIST = "(select distinct * from {})"


def distinct(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return table(spark, d, name, *cols).distinct()


# projections and filters


@R("pf01_projection", "select task_id, worker_id, status, exec_start_ms, exec_end_ms from tasks")
def _(spark, d):
    return table(spark, d, T, "task_id", "worker_id", "status", "exec_start_ms", "exec_end_ms")


@R("pf02_equality", "select task_id, name, status, worker_id from tasks where worker_id = 17 and status = 'FAILED'")
def _(spark, d):
    return P.matching(table(spark, d, T, "task_id", "name", "status", "worker_id"), worker_id=17, status="FAILED", name=None)


@R("pf03_search", "select task_id, name, name ilike '%_CELL%' as wild, contains(lower(name), '_cell') as literal from tasks where name ilike '%_CELL%'")
def _(spark, d):
    return table(spark, d, T, "task_id", "name").where(P.like("name", "_CELL")).select("task_id", "name", P.like("name", "_CELL").alias("wild"), P.like("name", "_CELL", escape=True).alias("literal"))


@R("pf04_range", "select worker_id, epoch_ms, kind from worker_samples where epoch_ms >= 1738560000000 and epoch_ms <= 1738580000000 and epoch_ms > 1738562401478")
def _(spark, d):
    return table(spark, d, SA, "worker_id", "epoch_ms", "kind").where(P.in_range("epoch_ms", 1738560000000, 1738580000000, 1738562401478))


@R("pf05_cursors", "with c as (select worker_id, max(first_seen_ms) + 1800000 as k from workers group by 1) select s.worker_id, epoch_ms from worker_samples s join c on s.worker_id = c.worker_id where epoch_ms > k")
def _(spark, d):
    c, _ = broadcast_if_small(table(spark, d, W, "worker_id", "first_seen_ms").groupBy("worker_id").agg((F.max("first_seen_ms") + 1_800_000).alias("cursor")), 1_000_000)
    return P.after_cursors(table(spark, d, SA, "worker_id", "epoch_ms"), c, "worker_id", "epoch_ms")


@R("pf06_changed", "select task_id, exec_start_ms, completed_ms from tasks where exec_start_ms > 0 and (exec_start_ms > 1738570000000 or completed_ms > 1738570000000)")
def _(spark, d):
    return P.changed_since(table(spark, d, T, "task_id", "exec_start_ms", "completed_ms"), 1738570000000, "exec_start_ms", "completed_ms")


@R("pf07_in_list", "select worker_id, last_event, last_event_ms from workers where last_event in ('DEAD', 'EXITED', 'DISCONNECT')")
def _(spark, d):
    return table(spark, d, W, "worker_id", "last_event", "last_event_ms").where(F.col("last_event").isin("DEAD", "EXITED", "DISCONNECT"))


@R("pf08_hide_internal", "select task_id, name, module from tasks where is_internal <> 1")
def _(spark, d):
    return table(spark, d, T, "task_id", "name", "module", "is_internal").where("is_internal <> 1").drop("is_internal")


DERIVED = """select task_id, coalesce(nullif(started_ms, 0), created_ms) - coalesce(nullif(ready_ms, 0), created_ms) as queue_ms,
 coalesce(nullif(exec_end_ms, 0), nullif(exec_start_ms, 0)) - nullif(exec_start_ms, 0) as duration_ms from tasks"""


@R("pf09_derived", DERIVED)
def _(spark, d):
    t = table(spark, d, T, "task_id", "created_ms", "ready_ms", "started_ms", "exec_start_ms", "exec_end_ms")
    return t.select("task_id", S.queue_ms().alias("queue_ms"), S.duration_ms().alias("duration_ms"))


STATE = """with e as (select worker_id, min(last_event_ms) as c from workers where last_event = 'EXITED' group by 1)
select w.worker_id, w.last_event, w.last_event_ms, case when last_event = 'DEAD' then case when c <= last_event_ms then 'EXITED' else 'DEAD' end else last_event end as state
from (select distinct worker_id, last_event, last_event_ms from workers) w left join e on w.worker_id = e.worker_id"""


@R("pf10_state", STATE)
@R("jn03_first_command", STATE)
def _(spark, d):
    w = distinct(spark, d, W, "worker_id", "last_event", "last_event_ms")
    c = w.where("last_event = 'EXITED'").groupBy("worker_id").agg(F.min("last_event_ms").alias("c"))
    dead = F.when(F.col("c") <= F.col("last_event_ms"), "EXITED").otherwise("DEAD")
    return w.join(c, "worker_id", "left").select("worker_id", "last_event", "last_event_ms", F.when(F.col("last_event") == "DEAD", dead).otherwise(F.col("last_event")).alias("state"))


LOAD = """with t as (select distinct task_id, worker_id, exec_start_ms s, exec_end_ms e, coalesce(cpu_time_ms, 0) c, coalesce(read_time_ms, 0) + coalesce(write_time_ms, 0) io, ready_ms r
 from tasks where exec_start_ms > 0 and exec_end_ms > 0),
x as (select *, greatest(e - s, 1) as x from t)
select task_id, worker_id, s as exec_start_ms, c * 1.0::double / x as cpu, io * 1.0::double / x as io, greatest(x - c - io, 0) * 1.0::double / x as wait,
 case when c * 1.0::double / x >= 0.5 then 'high' when c * 1.0::double / x >= 0.1 then 'mid' else 'low' end as tier, x < 500 as fast from x"""


def _loads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T, "task_id", "worker_id", "exec_start_ms", "exec_end_ms", "cpu_time_ms", "read_time_ms", "write_time_ms").where("exec_start_ms > 0 and exec_end_ms > 0").distinct()
    return S.load_shares(t, F.greatest(F.col("exec_end_ms") - F.col("exec_start_ms"), F.lit(1)))


@R("pf11_load_shares", f"select distinct task_id, worker_id, exec_start_ms, cpu, io, wait from ({LOAD})")
def _(spark, d):
    return _loads(spark, d).select("task_id", "worker_id", "exec_start_ms", "cpu", "io", "wait").distinct()


@R("pf12_tiers", f"select distinct task_id, worker_id, exec_start_ms, tier, fast from ({LOAD})")
def _(spark, d):
    return _loads(spark, d).select("task_id", "worker_id", "exec_start_ms", S.tier("cpu").alias("tier"), (F.col("x") < 500).alias("fast")).distinct()


@R("pf13_percent_split", """with t as (select distinct task_id, exec_start_ms, greatest(exec_end_ms - exec_start_ms, 1) x, coalesce(cpu_time_ms, 0) c, coalesce(read_time_ms, 0) + coalesce(write_time_ms, 0) io from tasks where exec_start_ms > 0 and exec_end_ms > 0),
p as (select *, least(cast(floor(100.0::double * c / x + 0.5) as bigint), 100) as pc from t)
select distinct task_id, exec_start_ms, pc as cpu_pct, least(cast(floor(100.0::double * io / x + 0.5) as bigint), 100 - pc) as io_pct from p""")
def _(spark, d):
    return S.percent_split(_loads(spark, d)).select("task_id", "exec_start_ms", "cpu_pct", "io_pct").distinct()


@R("pf15_optional_criteria", "select distinct worker_id, hostname, role from workers where role = 'compute' and hostname is not distinct from null")
def _(spark, d):
    w = table(spark, d, W, "worker_id", "hostname", "role")
    return P.matching(w, role="compute").where(F.col("hostname").eqNullSafe(F.lit(None))).distinct()


@R("pf16_flags", "select id, direction = 'r' as is_read, direction = 'w' as is_write, bytes is null as unknown_size from object_io")
def _(spark, d):
    return table(spark, d, IO, "id", "direction", "bytes").select("id", (F.col("direction") == "r").alias("is_read"), (F.col("direction") == "w").alias("is_write"), F.col("bytes").isNull().alias("unknown_size"))


@R("pf19_nonzero", "select worker_id, epoch_ms, proc_rss_bytes from worker_samples where proc_rss_bytes <> 0")
def _(spark, d):
    return table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes").where("proc_rss_bytes <> 0")


@R("pf20_default_on_read", "select o.id, coalesce(t.module, 'unknown') as module from object_io o left join (select task_id, max(module) as module from tasks group by 1) t on o.task_id = t.task_id")
def _(spark, d):
    t = table(spark, d, T, "task_id", "module").groupBy("task_id").agg(F.max("module").alias("module"))
    return table(spark, d, IO, "id", "task_id").join(t, "task_id", "left").select("id", F.coalesce("module", F.lit("unknown")).alias("module"))


@R("pf23_memory_over_baseline", "select task_id, greatest(mem_peak_bytes - mem_baseline_bytes, 0) as over_bytes from tasks")
def _(spark, d):
    return table(spark, d, T, "task_id", "mem_peak_bytes", "mem_baseline_bytes").select("task_id", S.over_baseline("mem_peak_bytes", "mem_baseline_bytes").alias("over_bytes"))


# latest rows and joins

LATEST = "select worker_id, max(epoch_ms) as epoch_ms from worker_samples group by 1"


@R("jn01_latest", f"select distinct s.worker_id, s.epoch_ms, s.proc_rss_bytes, s.host_cpu_bps from worker_samples s join ({LATEST}) l on s.worker_id = l.worker_id and s.epoch_ms = l.epoch_ms")
def _(spark, d):
    return O.latest(table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes", "host_cpu_bps"), ["worker_id"], ["epoch_ms"])


@R("jn02_with_latest", f"""with l as (select distinct s.worker_id, s.epoch_ms, s.proc_rss_bytes from worker_samples s join ({LATEST}) l on s.worker_id = l.worker_id and s.epoch_ms = l.epoch_ms)
select w.worker_id, w.hostname, l.epoch_ms, l.proc_rss_bytes from (select distinct worker_id, hostname from workers) w left join l on w.worker_id = l.worker_id""")
def _(spark, d):
    return O.with_latest(distinct(spark, d, W, "worker_id", "hostname"), table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes"), "worker_id", ["epoch_ms"], ["epoch_ms", "proc_rss_bytes"])


@R("jn04_children", """with o as (select distinct id, task_id, direction, object_name, bytes from object_io), r as (select *, row_number() over (partition by task_id order by id) n from o),
e as (select distinct task_id, status, created_ms from tasks), a as (select task_id, count(*) as n_snapshots, min(created_ms) as first_ms from e group by 1),
i as (select task_id, count(*) as n_io, list(object_name order by id) as objects from r where n <= 500 group by 1)
select a.task_id, n_snapshots, first_ms, coalesce(n_io, 0) as n_io, array_to_string(objects, ',') as objects from a left join i on a.task_id = i.task_id""")
def _(spark, d):
    io = O.quota(distinct(spark, d, IO, "id", "task_id", "direction", "object_name", "bytes"), "task_id", ["id"], F.lit(500))
    io = io.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_io"), F.array_sort(F.collect_list(F.struct("id", "object_name"))).alias("o"))
    t = distinct(spark, d, T, "task_id", "status", "created_ms").groupBy("task_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.min("created_ms").alias("first_ms"))
    return t.join(io, "task_id", "left").select("task_id", "n_snapshots", "first_ms", F.coalesce("n_io", F.lit(0).cast("bigint")).alias("n_io"), F.array_join("o.object_name", ",").alias("objects"))


# aggregates


@R("ag01_status_counts", "select status, count(*) as n, coalesce(min(created_ms), 0) as first_ms, coalesce(max(created_ms), 0) as last_ms from tasks group by status")
def _(spark, d):
    return table(spark, d, T, "status", "created_ms").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("created_ms"), F.lit(0)).alias("first_ms"), F.coalesce(F.max("created_ms"), F.lit(0)).alias("last_ms"))


@R("ag02_first_event", "select worker_id, min(exec_start_ms) as first_ms from tasks where status = 'FAILED' group by worker_id")
def _(spark, d):
    return table(spark, d, T, "worker_id", "exec_start_ms", "status").where("status = 'FAILED'").groupBy("worker_id").agg(F.min("exec_start_ms").alias("first_ms"))


@R("ag03_event_pivot", """with e as (select epoch_ms t, id, direction, object_name, cast(bytes as varchar) b from object_io), x as (select regexp_replace(object_name, ':[^:]*$', '') as db, e.* from e)
select db, min(case when direction = 'w' then t end) as created_ms, max(case when direction = 'r' then t end) as last_read_ms,
 arg_max(try_cast(b as bigint), struct_pack(t := t, id := id)) filter (b is not null) as last_bytes
from x group by db having min(case when direction = 'w' then t end) is not null""")
def _(spark, d):
    x = table(spark, d, IO, "id", "epoch_ms", "direction", "object_name", "bytes").withColumn("db", S.before_last("object_name", ":"))
    last = F.when(F.col("bytes").isNotNull(), F.struct("epoch_ms", "id", S.int_after_last(F.concat("object_name", F.lit("|"), F.col("bytes").cast("string")), "|").alias("b")))
    return x.groupBy("db").agg(F.min(F.when(F.col("direction") == "w", F.col("epoch_ms"))).alias("created_ms"), F.max(F.when(F.col("direction") == "r", F.col("epoch_ms"))).alias("last_read_ms"), F.max(last).getField("b").alias("last_bytes")).where("created_ms is not null")


TICK = 600_000
TOTALS = f"""with s as (select distinct worker_id k, epoch_ms t, proc_rss_bytes v from worker_samples where proc_rss_bytes > 0 and proc_rss_bytes < 1000000000000),
c as (select k, cast(ceil(t / {TICK}.0) as bigint) tick, t, v from s), l as (select k, tick, v from (select *, row_number() over (partition by k, tick order by t desc, v desc) n from c) where n = 1),
g as (select tick, v - coalesce(lag(v) over (partition by k order by tick), 0) dv from l), p as (select tick, sum(dv) dv from g group by tick),
x as (select tick * {TICK} as tick, cast(sum(dv) over (order by tick) as bigint) as total from p)"""


def _totals(spark, d):
    s = table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes").where("proc_rss_bytes < 1000000000000")
    return O.totals_at_ticks(s, "worker_id", "epoch_ms", "proc_rss_bytes", TICK)


@R("jn17_asof_totals", f"{TOTALS} select * from x")
def _(spark, d):
    return _totals(spark, d)


@R("jn17_asof_dead", f"""with s as (select distinct worker_id k, epoch_ms t, proc_rss_bytes v from worker_samples where proc_rss_bytes > 0 and proc_rss_bytes < 1000000000000),
e as (select worker_id k, max(last_event_ms) e from workers where last_event = 'DEAD' group by 1), a as (select s.* from s left join e on s.k = e.k where e.e is null or s.t > e.e),
c as (select k, cast(ceil(t / {TICK}.0) as bigint) tick, t, v from a), l as (select k, tick, v from (select *, row_number() over (partition by k, tick order by t desc, v desc) n from c) where n = 1),
g as (select tick, v - coalesce(lag(v) over (partition by k order by tick), 0) dv from l), p as (select tick, sum(dv) dv from g group by tick)
select tick * {TICK} as tick, cast(sum(dv) over (order by tick) as bigint) as total from p""")
def _(spark, d):
    s = table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes").where("proc_rss_bytes < 1000000000000")
    ends = table(spark, d, W, "worker_id", "last_event", "last_event_ms").where("last_event = 'DEAD'").groupBy("worker_id").agg(F.max("last_event_ms").alias("end_ms"))
    return O.totals_at_ticks(s, "worker_id", "epoch_ms", "proc_rss_bytes", TICK, ends, drop_before_end=True)


@R("jn17_asof_rows", """with t as (select distinct task_id, worker_id, exec_start_ms from tasks where exec_start_ms > 0), s as (select worker_id w, epoch_ms e, max(coalesce(kind, -1)) k from worker_samples group by 1, 2)
select task_id, worker_id, exec_start_ms, e as asof_epoch_ms, k as asof_kind from t asof left join s on t.worker_id = s.w and t.exec_start_ms >= s.e""")
def _(spark, d):
    t = distinct(spark, d, T, "task_id", "worker_id", "exec_start_ms").where("exec_start_ms > 0")
    s = table(spark, d, SA, "worker_id", "epoch_ms", "kind").withColumn("kind", F.coalesce("kind", F.lit(-1)))
    return O.asof(t, s, "worker_id", "exec_start_ms", "epoch_ms", ["epoch_ms", "kind"])


@R("ag21_window_stats", f"{TOTALS} select cast(floor(sum(total) / count(*)) as bigint) as avg, max(total) as peak from x where tick between 1738560000000 and 1738600000000")
def _(spark, d):
    return _totals(spark, d).agg(*O.window_stats(None, "tick", "total", F.lit(1738560000000), F.lit(1738600000000)))


@R("ag22_phases", f"""{TOTALS}, r as (select tick - min(tick) over () as t, total from x), z as (select max(t) dur, count(*) m from r),
ph as (select i + 1 as phase, dur * i // k as lo, case when i = k - 1 then dur else dur * (i + 1) // k - 1 end as hi from (select dur, case when m < 10 then 1 else 10 end k from z), (select unnest(range(10)) i) where i < k)
select cast(phase as integer) as phase, lo, hi, cast(floor(sum(total) / count(total)) as bigint) as avg, max(total) as peak from ph left join r on t between lo and hi group by phase, lo, hi""")
def _(spark, d):
    x = _totals(spark, d)
    r = x.crossJoin(one_row(x.agg(F.min("tick").alias("_a")))).select((F.col("tick") - F.col("_a")).alias("t"), "total")
    return O.phases(r, "t", "total")


@R("ag23_span_stats", f"""{TOTALS}, b as (select regexp_replace(object_name, ':[^:]*$', '') as db, min(epoch_ms) a, max(epoch_ms) z from object_io group by 1)
select db, a as first_ms, z as last_ms, cast(floor(sum(total) / count(total)) as bigint) as avg, max(total) as peak from b left join x on tick between a and z group by db, a, z""")
def _(spark, d):
    b = table(spark, d, IO, "object_name", "epoch_ms").groupBy(S.before_last("object_name", ":").alias("db")).agg(F.min("epoch_ms").alias("first_ms"), F.max("epoch_ms").alias("last_ms"))
    day = lambda c: F.floor(F.col(c) / O.SHARD_MS)  # noqa: E731  spans and ticks meet by the day
    x = _totals(spark, d).withColumn("day", day("tick"))
    j = b.withColumn("day", F.explode(F.sequence(day("first_ms"), day("last_ms")))).join(x, "day", "left")
    inside = F.when(F.col("tick").between(F.col("first_ms"), F.col("last_ms")), F.col("total"))
    return j.groupBy("db", "first_ms", "last_ms").agg(F.floor(F.sum(inside) / F.count(inside)).cast("bigint").alias("avg"), F.max(inside).alias("peak"))


HOUR = 3_600_000
GRID = f"""with s as (select worker_id k, epoch_ms // {HOUR} b, epoch_ms t, host_cpu_bps c, proc_rss_bytes r from worker_samples),
l as (select k, b, c, r from (select *, row_number() over (partition by k, b order by t desc, c desc nulls last, r desc nulls last) n from s) where n = 1), u as (select distinct b from l),
f as (select k, min(b) a from l group by k), g as (select f.k, u.b from f, u where u.b >= f.a),
z as (select g.k, g.b, last_value(l.b ignore nulls) over (partition by g.k order by g.b) src, l.b is not null as fresh from g left join l on g.k = l.k and g.b = l.b),
o as (select z.k as worker_id, z.b as bucket, l.c as host_cpu_bps, l.r as proc_rss_bytes, z.fresh from z join l on z.k = l.k and z.src = l.b)"""


def _grid(spark, d):
    return O.carried(table(spark, d, SA, "worker_id", "epoch_ms", "host_cpu_bps", "proc_rss_bytes"), "worker_id", "epoch_ms", ["host_cpu_bps", "proc_rss_bytes"], HOUR)


@R("wn02_carried", f"{GRID} select * from o")
def _(spark, d):
    return _grid(spark, d)


@R("ag24_bucket_totals", f"{GRID} select bucket, cast(sum(case when proc_rss_bytes between 0 and 1000000000000 then proc_rss_bytes end) as bigint) as rss, max(host_cpu_bps) as cpu, count(*) as n_workers from o group by bucket")
def _(spark, d):
    return _grid(spark, d).groupBy("bucket").agg(F.sum(F.when(F.col("proc_rss_bytes").between(0, 1000000000000), F.col("proc_rss_bytes"))).alias("rss"), F.max("host_cpu_bps").alias("cpu"), F.count(F.lit(1)).alias("n_workers"))


@R("ag25_distinct_hosts", "select count(distinct hostname) as hosts, count(distinct worker_id) as lanes, count(distinct role) as roles from workers")
def _(spark, d):
    return table(spark, d, W, "hostname", "worker_id", "role").agg(F.countDistinct("hostname").alias("hosts"), F.countDistinct("worker_id").alias("lanes"), F.countDistinct("role").alias("roles"))


@R("ag52_message_counters", """with s as (select module, name, status, count(*) c from tasks group by all)
select coalesce(module, '') as domain, name as id, cast(sum(c) as bigint) as triggered, cast(least(sum(c), case when module = 'flow.solve' then 5 else 20 end) as bigint) as emitted from s group by module, name""")
def _(spark, d):
    t = table(spark, d, T, "module", "name").groupBy("module", "name").agg(F.count(F.lit(1)).alias("triggered"))
    cap = F.when(F.col("module") == "flow.solve", 5).otherwise(20)
    return t.select(F.coalesce("module", F.lit("")).alias("domain"), F.col("name").alias("id"), "triggered", F.least(F.col("triggered"), cap.cast("bigint")).alias("emitted"))


DECAY = 0.0005


@R("ag53_decayed", f"""with x as (select object_name, epoch_ms // 1000 t, coalesce(bytes, 0) b from object_io), m as (select object_name, max(t) z from x group by 1)
select x.object_name, z as last_s, round(sum(b * pow({1 - DECAY}, z - t)), 1) as bytes, round(sum(1.0::double * pow({1 - DECAY}, z - t)), 4) as n from x join m on x.object_name = m.object_name group by x.object_name, z""")
def _(spark, d):
    x = table(spark, d, IO, "object_name", "epoch_ms", "bytes").select("object_name", F.floor(F.col("epoch_ms") / 1000).alias("t"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit(1.0).alias("n"))
    return O.decayed(x, "object_name", "t", ["bytes", "n"], DECAY).select("object_name", "last_s", F.round("bytes", 1).alias("bytes"), F.round("n", 4).alias("n"))


@R("ag54_bytes_held", "select worker_id, cast(sum(bytes) as bigint) as bytes, count(distinct object_name) as n_objects from object_io where direction = 'w' group by worker_id")
def _(spark, d):
    return table(spark, d, IO, "worker_id", "bytes", "object_name", "direction").where("direction = 'w'").groupBy("worker_id").agg(F.sum("bytes").alias("bytes"), F.countDistinct("object_name").alias("n_objects"))


@R("ag55_task_memory", "select module, name, cast(floor(avg(mem_avg_bytes)) as bigint) as mem_avg, max(mem_peak_bytes) as mem_peak, count(mem_avg_bytes) as n, cast(ceil(sum(cpu_time_ms) / 1000.0) as bigint) as cpu_s from tasks group by module, name")
def _(spark, d):
    return table(spark, d, T, "module", "name", "mem_avg_bytes", "mem_peak_bytes", "cpu_time_ms").groupBy("module", "name").agg(F.floor(F.avg("mem_avg_bytes")).alias("mem_avg"), F.max("mem_peak_bytes").alias("mem_peak"), F.count("mem_avg_bytes").alias("n"), F.ceil(F.sum("cpu_time_ms") / 1000.0).alias("cpu_s"))


@R("ag57_joined_set", "with x as (select distinct task_id, unnest(string_split(dbs, ',')) b from tasks where dbs is not null) select task_id, string_agg(b, ',' order by b) as dbs from x where b <> '' group by task_id")
def _(spark, d):
    x = table(spark, d, T, "task_id", "dbs").select("task_id", F.explode(F.split("dbs", ",")).alias("b")).where("b <> ''")
    return x.groupBy("task_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("b"))).alias("dbs"))


# ordered analytics


@R("wn01_rates", """with x as (select worker_id, epoch_ms, net_read_bytes from (select distinct worker_id, epoch_ms, net_read_bytes from worker_samples) where net_read_bytes >= 0),
p as (select *, lag(epoch_ms) over w pt, lag(net_read_bytes) over w pv from x window w as (partition by worker_id order by epoch_ms, net_read_bytes))
select worker_id, epoch_ms, net_read_bytes, case when (epoch_ms - pt) / 1000.0::double > 0 then round(greatest(net_read_bytes - pv, 0) / ((epoch_ms - pt) / 1000.0::double), 1) end as rate from p""")
def _(spark, d):
    x = table(spark, d, SA, "worker_id", "epoch_ms", "net_read_bytes").where("net_read_bytes >= 0").distinct()
    return O.rates(x, "worker_id", "epoch_ms", "net_read_bytes")


@R("wn07_quota", """with q as (select distinct task_id, module, name, created_ms from tasks), n as (select *, row_number() over (partition by module, name order by created_ms, task_id) n from q)
select task_id, module, name, created_ms from n where case when name = 'one_off' then -1 when module = 'flow.solve' then 5 when module = 'qa.check' then 0 else 20 end < 0
 or n <= case when name = 'one_off' then -1 when module = 'flow.solve' then 5 when module = 'qa.check' then 0 else 20 end""")
def _(spark, d):
    limit = F.coalesce(F.when(F.col("name") == "one_off", -1), F.when(F.col("module") == "flow.solve", 5).when(F.col("module") == "qa.check", 0), F.lit(20))
    t = distinct(spark, d, T, "task_id", "module", "name", "created_ms")
    # only the first rows of an id can pass: they are found per day before one task sees the id
    day = t.withColumn("_k", F.concat_ws("|", F.coalesce("module", F.lit("\0")), "name", F.floor(F.col("created_ms") / O.SHARD_MS).cast("string")))
    day = O.quota(day, "_k", ["created_ms", "task_id"], limit).withColumn("_k", F.concat_ws("|", F.coalesce("module", F.lit("\0")), "name"))
    return O.quota(day, "_k", ["created_ms", "task_id"], limit).drop("_k")


@R("wn09_cache_score", f"""with x as (select object_name, count(*) filter (direction = 'r') as n_reads, max(epoch_ms) as last_ms, max(bytes) as size from object_io group by 1), t as (select max(epoch_ms) + 1000 as t from object_io)
select object_name, n_reads, round(n_reads * 1000.0::double / (t - last_ms) * case when size > 1000000 then 0.5 else 1.0 end, 9) as score from x, t""")
def _(spark, d):
    io = table(spark, d, IO, "object_name", "direction", "epoch_ms", "bytes")
    x = io.groupBy("object_name").agg(F.count_if(F.col("direction") == "r").alias("n_reads"), F.max("epoch_ms").alias("last_ms"), F.max("bytes").alias("size"))
    now = io.agg((F.max("epoch_ms") + 1000).alias("t"))
    return x.crossJoin(one_row(now)).select("object_name", "n_reads", F.round(F.col("n_reads") * 1000.0 / (F.col("t") - F.col("last_ms")) * F.when(F.col("size") > 1_000_000, 0.5).otherwise(1.0), 9).alias("score"))


@R("wn10_cursor", "select worker_id, max(greatest(exec_start_ms, completed_ms)) as cursor_ms from tasks where exec_start_ms > 0 group by worker_id")
def _(spark, d):
    return table(spark, d, T, "worker_id", "exec_start_ms", "completed_ms").where("exec_start_ms > 0").groupBy("worker_id").agg(F.max(F.greatest("exec_start_ms", "completed_ms")).alias("cursor_ms"))


# pages and order


def sort_keys() -> dict:
    """Sort keys of the task list by their names in the API."""
    return {"id": F.col("task_id"), "name": F.col("name"), "status": F.col("status"), "worker": F.col("worker_id"), "created": F.col("created_ms"), "cpu": F.col("cpu_time_ms"), "read": F.col("read_bytes"), "write": F.col("write_bytes"), "queue": S.queue_ms(), "duration": S.duration_ms()}


@R("tk01_page", """with t as (select distinct task_id, status, worker_id, created_ms, cpu_time_ms from tasks where status = 'COMPLETED'), n as (select count(*) total from t)
select task_id, worker_id, cpu_time_ms, total from t, n order by cpu_time_ms desc nulls last, task_id desc, created_ms, worker_id limit 100 offset 20""")
def _(spark, d):
    t = distinct(spark, d, T, "task_id", "status", "worker_id", "created_ms", "cpu_time_ms").where("status = 'COMPLETED'")
    return P.page(t, sort_keys(), "cpu", True, "task_id", 100, 20).select("task_id", "worker_id", "cpu_time_ms", "total")


@R("tk02_newest", "select distinct event_id, event_type, user_id from events order by event_id desc limit 200")
def _(spark, d):
    return table(spark, d, "events", "event_id", "event_type", "user_id").distinct().orderBy(F.desc("event_id")).limit(min(max(200, 1), P.MAX_LIMIT))


@R("tk03_first_io", "with o as (select distinct id, task_id, object_name from object_io where task_id = 2) select * from o order by id limit 500")
def _(spark, d):
    return distinct(spark, d, IO, "id", "task_id", "object_name").where("task_id = 2").orderBy("id").limit(500)


@R("tk04_two_keys", "select worker_id, epoch_ms, kind from worker_samples where kind = 1 order by worker_id, epoch_ms")
def _(spark, d):
    return table(spark, d, SA, "worker_id", "epoch_ms", "kind").where("kind = 1").orderBy("worker_id", "epoch_ms")


@R("tk05_ready_queue", "select task_id, priority, created_ms from tasks where status = 'PENDING' order by priority desc, task_id")
def _(spark, d):
    return table(spark, d, T, "task_id", "priority", "created_ms", "status").where("status = 'PENDING'").drop("status").orderBy(F.desc("priority"), "task_id")


@R("tk07_replica_target", """with h as (select object_name, min(worker_id) src from object_io where direction = 'w' and worker_id > 0 group by 1), u as (select worker_id, sum(coalesce(bytes, 0)) held from object_io where direction = 'w' and worker_id > 0 group by 1),
w as (select worker_id, min(coalesce(hostname, '')) host, max(case when role = 'storage' then 0 else 1 end) r from workers group by 1),
c as (select w.worker_id, w.host, w.r, cast(coalesce(held, 0) as bigint) held from w left join u on w.worker_id = u.worker_id), b as (select distinct src, coalesce(s.host, '') host from h left join w s on h.src = s.worker_id),
k as (select b.src, c.worker_id as target, row_number() over (partition by b.src order by case when c.host = b.host then 1 else 0 end, c.r, c.held, c.worker_id) n from b, c where c.worker_id <> b.src)
select h.object_name, h.src as source, k.target from h join k on h.src = k.src and n = 1""")
def _(spark, d):
    io = table(spark, d, IO, "object_name", "worker_id", "direction", "bytes").where("direction = 'w' and worker_id > 0")
    h = io.groupBy("object_name").agg(F.min("worker_id").alias("source"))
    held = io.groupBy("worker_id").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("held"))
    w = table(spark, d, W, "worker_id", "hostname", "role").groupBy("worker_id").agg(F.min(F.coalesce("hostname", F.lit(""))).alias("host"), F.max(F.when(F.col("role") == "storage", 0).otherwise(1)).alias("r"))
    c = w.join(held, "worker_id", "left").select("worker_id", "host", F.struct("r", F.coalesce("held", F.lit(0)).alias("held"), F.col("worker_id").alias("id")).alias("rank"))
    # the best candidate of the best two hosts, and the best two of each host, decide every source: no source meets every candidate
    hosts = c.groupBy("host").agg(F.min("rank").alias("a"))
    two_hosts = hosts.orderBy("a").limit(2).agg(F.array_sort(F.collect_list(F.struct("a", "host"))).alias("hosts"))
    second = c.join(hosts, "host").where(F.col("rank") > F.col("a")).groupBy("host").agg(F.min("rank").alias("z"))
    src = h.select("source").distinct().join(w.select(F.col("worker_id").alias("source"), "host"), "source", "left").withColumn("host", F.coalesce("host", F.lit("")))
    j = src.crossJoin(one_row(two_hosts)).join(hosts, "host", "left").join(second, "host", "left")
    other = F.get(F.filter("hosts", lambda x: x["host"] != F.col("host")), F.lit(0))["a"]["id"]
    same = F.when(F.col("a.id") != F.col("source"), F.col("a.id")).otherwise(F.col("z.id"))
    return h.join(j.select("source", F.coalesce(other, same).alias("target")), "source").where("target is not null").select("object_name", "source", "target")


@R("tk09_lanes", "select distinct hostname, worker_id from workers order by hostname, worker_id")
def _(spark, d):
    return distinct(spark, d, W, "hostname", "worker_id").orderBy(F.asc_nulls_last("hostname"), "worker_id")


# incremental forms as batch queries


@R("sm03_idempotent_append", "select distinct worker_id, epoch_ms from worker_samples")
def _(spark, d):
    return table(spark, d, SA, "worker_id", "epoch_ms").dropDuplicates(["worker_id", "epoch_ms"])


@R("sm04_upsert", """with x as (select distinct task_id, status, created_ms, completed_ms, worker_id, cpu_time_ms, case status when 'PENDING' then 0 when 'RUNNING' then 1 else 2 end r from tasks)
select task_id, status, completed_ms, worker_id, cpu_time_ms from (select *, row_number() over (partition by task_id order by r desc, completed_ms desc nulls last, worker_id desc nulls last, cpu_time_ms desc nulls last, created_ms desc nulls last, status desc) n from x) where n = 1""")
def _(spark, d):
    r = F.when(F.col("status") == "PENDING", 0).when(F.col("status") == "RUNNING", 1).otherwise(2)
    t = table(spark, d, T, "task_id", "status", "created_ms", "completed_ms", "worker_id", "cpu_time_ms").withColumn("r", r)
    return O.latest(t, ["task_id"], ["r", "completed_ms", "worker_id", "cpu_time_ms", "created_ms", "status"]).select("task_id", "status", "completed_ms", "worker_id", "cpu_time_ms")

