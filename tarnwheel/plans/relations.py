"""Joins with account of misses, merges, sets, word counts, lookup tables and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import locality as LB
from ..operators import lookup as L
from ..operators import mapreduce as M
from ..operators import merge as J
from ..operators import ordered as O
from ..session import broadcast_if_small, table
from .base import Register

R = Register()
QUERIES, SQL = R.queries, R.sql
IO, T, W, SA, LI = "object_io", "tasks", "workers", "worker_samples", "lineitem"


@R("jn05_full_outer", "select coalesce(a.k, b.k) as worker_id, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'left' else 'right' end as side from (select distinct worker_id k from workers) a full join (select distinct worker_id k from worker_samples) b on a.k = b.k")
def _(spark, d):
    return J.linked(table(spark, d, W, "worker_id"), table(spark, d, SA, "worker_id"), "worker_id")


@R("jn05_unmatched_counts", "select case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'left' else 'right' end as side, count(*) as n from (select distinct p_partkey k from part) a full join (select distinct l_partkey k from lineitem) b on a.k = b.k group by 1")
def _(spark, d):
    return J.linked(table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, LI).select(F.col("l_partkey").alias("k")), "k").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


DIFF = """with a as (select distinct worker_id, name from tasks where status = 'FAILED'), b as (select distinct worker_id, name from tasks where status = 'COMPLETED')
select worker_id, name, 'left' as only from (select * from a except select * from b) union all select worker_id, name, 'right' from (select * from b except select * from a)"""


@R("jn06_set_differences", DIFF)
@R("st04_set_difference", DIFF)
def _(spark, d):
    t = table(spark, d, T, "worker_id", "name", "status")
    return J.set_differences(t.where("status = 'FAILED'"), t.where("status = 'COMPLETED'"), "worker_id", "name")


@R("jn07_fallback", """with t as (select worker_id, min(coalesce(hostname, '')) h, min(coalesce(role, '')) r from workers group by 1)
select o.id, o.worker_id, case when t.worker_id is null then 'unregistered_' || o.worker_id else h end as host, case when t.worker_id is null then 'none' else r end as role, t.worker_id is null as fallback from object_io o left join t on o.worker_id = t.worker_id""")
def _(spark, d):
    w = table(spark, d, W, "worker_id", "hostname", "role").groupBy("worker_id").agg(F.min(F.coalesce("hostname", F.lit(""))).alias("host"), F.min(F.coalesce("role", F.lit(""))).alias("role"))
    return J.with_fallback(table(spark, d, IO, "id", "worker_id"), w, "worker_id", {"host": F.concat(F.lit("unregistered_"), F.col("worker_id").cast("string")), "role": F.lit("none")}).select("id", "worker_id", "host", "role", "fallback")


REJECT = """with t as (select task_id, max(exec_start_ms) s, max(exec_end_ms) e, max(worker_id) w from tasks group by 1), k as (select distinct worker_id from workers),
x as (select o.id, o.bytes, case when t.task_id is null then 'no_task' when k.worker_id is null then 'no_worker' when o.bytes is null then 'no_size' when coalesce(s, 0) = 0 then 'not_started' when o.epoch_ms < s or (e > 0 and o.epoch_ms > e) then 'outside' else 'ok' end reason
 from object_io o left join t on o.task_id = t.task_id left join k on o.worker_id = k.worker_id)"""


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T, "task_id", "exec_start_ms", "exec_end_ms").groupBy("task_id").agg(F.max("exec_start_ms").alias("s"), F.max("exec_end_ms").alias("e"), F.lit(True).alias("_t"))
    k = table(spark, d, W, "worker_id").distinct().withColumn("_k", F.lit(True))
    j = table(spark, d, IO, "id", "bytes", "epoch_ms", "task_id", "worker_id").join(t, "task_id", "left").join(k, "worker_id", "left")
    outside = (F.col("epoch_ms") < F.col("s")) | ((F.col("e") > 0) & (F.col("epoch_ms") > F.col("e")))
    return J.classified(j, [(F.col("_t").isNull(), "no_task"), (F.col("_k").isNull(), "no_worker"), (F.col("bytes").isNull(), "no_size"), (F.coalesce("s", F.lit(0)) == 0, "not_started"), (outside, "outside")]).select("id", "bytes", "reason")


@R("jn08_reject_reasons", REJECT + "select id, bytes, reason from x")
def _(spark, d):
    return _reasoned(spark, d)


@R("jn08_reject_counts", REJECT + "select reason, count(*) as n from x where reason <> 'ok' group by reason")
def _(spark, d):
    return J.split_by_reason(_reasoned(spark, d))[1]


@R("jn09_two_key_lookup", """with a as (select module || '::' || name k, max(cpu_time_ms) v from tasks where module is not null group by 1), b as (select name k, max(cpu_time_ms) v from tasks group by 1), q as (select distinct task_id, module, name from tasks)
select task_id, q.name, coalesce(a.v, b.v) as limit_ms, case when a.k is not null then 'full' when b.k is not null then 'plain' else 'none' end as found from q left join a on a.k = q.module || '::' || q.name left join b on b.k = q.name""")
def _(spark, d):
    t = table(spark, d, T, "task_id", "module", "name", "cpu_time_ms")
    full = F.concat(F.col("module"), F.lit("::"), F.col("name"))
    a = t.where("module is not null").groupBy(full.alias("ka")).agg(F.max("cpu_time_ms").alias("va"))
    b = t.groupBy(F.col("name").alias("kb")).agg(F.max("cpu_time_ms").alias("vb"))
    q = t.select("task_id", "module", "name").distinct().withColumn("full", full)
    j = q.join(a, q.full == a.ka, "left").join(b, q.name == b.kb, "left")
    return j.select("task_id", "name", F.coalesce("va", "vb").alias("limit_ms"), F.when(F.col("ka").isNotNull(), "full").when(F.col("kb").isNotNull(), "plain").otherwise("none").alias("found"))


SEG = 10


@R("jn13_segment_map", f"with m as (select task_id, min(worker_id) pid from tasks where worker_id > 0 group by 1) select o.id, o.task_id, o.task_id >> {SEG} as segment, m.pid from object_io o left join m on o.task_id = m.task_id")
@R("pq02_locate", f"with m as (select task_id, min(worker_id) pid from tasks where worker_id > 0 group by 1) select o.id, o.task_id, o.task_id >> {SEG} as segment, m.pid from object_io o left join m on o.task_id = m.task_id")
def _(spark, d):
    m = table(spark, d, T, "task_id", "worker_id").where("worker_id > 0").groupBy("task_id").agg(F.min("worker_id").alias("pid")).withColumn("segment", F.shiftright("task_id", SEG))
    o = table(spark, d, IO, "id", "task_id").withColumn("segment", F.shiftright("task_id", SEG))
    return o.join(m, ["segment", "task_id"], "left").select("id", "task_id", "segment", "pid")


@R("jn18_remap", "with m as (select user_id f, event_type l, dense_rank() over (order by user_id, event_type) - 1 as id from (select distinct user_id, event_type from events where event_type <> 'error')) select event_id, m.id as clock_id from events left join m on user_id = f and event_type = l")
def _(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    m = O.dense_ids(e.where("event_type <> 'error'").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "clock_id")
    return e.join(m, ["user_id", "event_type"], "left").select("event_id", "clock_id")


@R("jn19_drivers", """with w as (select object_name, count(distinct worker_id) n, array_to_string(list_sort(list(distinct worker_id)), ',') as drivers from object_io where direction = 'w' group by 1), r as (select object_name, count(*) readers from object_io where direction = 'r' group by 1)
select r.object_name, readers, coalesce(n, 0) as n_drivers, drivers, coalesce(n, 0) > 1 as multi from r left join w on r.object_name = w.object_name""")
def _(spark, d):
    io = table(spark, d, IO, "object_name", "direction", "worker_id")
    w = io.where("direction = 'w'").groupBy("object_name").agg(F.array_join(F.array_sort(F.collect_set("worker_id")).cast("array<string>"), ",").alias("drivers"), F.countDistinct("worker_id").alias("n"))
    r = io.where("direction = 'r'").groupBy("object_name").agg(F.count(F.lit(1)).alias("readers"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return r.join(w, "object_name", "left").select("object_name", "readers", n.alias("n_drivers"), "drivers", (n > 1).alias("multi"))


@R("jn24_membership", "select s.worker_id, count(*) filter (w.worker_id is not null) as inside, count(*) filter (w.worker_id is null) as outside from worker_samples s left join (select distinct worker_id from workers) w on s.worker_id = w.worker_id group by s.worker_id")
def _(spark, d):
    n = table(spark, d, SA, "worker_id").groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"))
    w = table(spark, d, W, "worker_id").distinct()
    zero = F.lit(0).cast("bigint")
    return n.join(w, "worker_id", "left_semi").select("worker_id", F.col("n").alias("inside"), zero.alias("outside")).unionByName(n.join(w, "worker_id", "left_anti").select("worker_id", zero.alias("inside"), F.col("n").alias("outside")))


LOCAL = """with h as (select object_name, worker_id, max(coalesce(bytes, 0)) b from object_io where direction = 'w' group by 1, 2), q as (select distinct task_id, object_name from object_io where direction = 'r'),
s as (select q.task_id, h.worker_id, cast(sum(b) as bigint) as bytes, count(*) as n_objects from q join h on q.object_name = h.object_name group by 1, 2)"""


def _reads_and_holders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(task, object) of what is read, (object, worker, bytes) of what was written where."""
    io = table(spark, d, IO, "object_name", "direction", "worker_id", "task_id", "bytes")
    h = io.where("direction = 'w'").groupBy("object_name", "worker_id").agg(F.max(F.coalesce("bytes", F.lit(0))).alias("b"))
    q = io.where("direction = 'r'").select("task_id", "object_name").distinct()
    return q.select(F.col("task_id").alias("task"), F.col("object_name").alias("object")), h.select(F.col("object_name").alias("object"), F.col("worker_id").alias("worker"), F.col("b").alias("bytes"))


@R("jn25_locality", LOCAL + "select * from s")
def _(spark, d):
    return LB.local_bytes(*_reads_and_holders(spark, d)).select(F.col("task").alias("task_id"), F.col("worker").alias("worker_id"), "bytes", "n_objects")


# outcomes

OUTCOME = """with w as (select distinct object_name from object_io where direction = 'w'), p as (select distinct split_part(object_name, ':', 2) s from object_io where direction = 'w'), n as (select distinct object_name, bytes is null as const from object_io where direction = 'r'),
x as (select n.*, case when w.object_name is not null then 'hit' when const and contains(n.object_name, ':') then case when p.s is not null then 'pin_hit' else 'skip' end else 'name_miss' end reason from n left join w on n.object_name = w.object_name left join p on split_part(n.object_name, ':', 2) = p.s)"""


@R("pf21_outcomes", OUTCOME + " select reason, count(*) as n from x group by reason")
def _(spark, d):
    io = table(spark, d, IO, "object_name", "direction", "bytes")
    w = io.where("direction = 'w'").select("object_name").distinct()
    p = w.select(F.split_part("object_name", F.lit(":"), F.lit(2)).alias("s")).distinct().withColumn("_p", F.lit(True))
    n = io.where("direction = 'r'").select("object_name", F.col("bytes").isNull().alias("const")).distinct()
    j = n.join(w.withColumn("_w", F.lit(True)), "object_name", "left").withColumn("s", F.split_part("object_name", F.lit(":"), F.lit(2))).join(p, "s", "left")
    retry = F.col("const") & F.contains("object_name", F.lit(":"))
    x = J.classified(j, [(F.col("_w").isNotNull(), "hit"), (retry & F.col("_p").isNotNull(), "pin_hit"), (retry, "skip")], ok="name_miss")
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@R("pf22_port_or_net", """with i as (select distinct worker_id, object_name from object_io where direction = 'w'), p as (select distinct object_name from object_io where direction = 'w'), q as (select distinct worker_id, object_name from object_io where direction = 'r')
select q.worker_id, q.object_name, case when i.object_name is not null then 'net' when p.object_name is null then 'miss' when q.object_name like '%blk_0000' then 'pg_skip' else 'port' end as kind from q left join i on q.worker_id = i.worker_id and q.object_name = i.object_name left join p on q.object_name = p.object_name""")
def _(spark, d):
    io = table(spark, d, IO, "object_name", "direction", "worker_id")
    w, q = io.where("direction = 'w'"), io.where("direction = 'r'").select("worker_id", "object_name").distinct()
    j = q.join(w.select("worker_id", "object_name").distinct().withColumn("_i", F.lit(True)), ["worker_id", "object_name"], "left").join(w.select("object_name").distinct().withColumn("_p", F.lit(True)), "object_name", "left")
    return J.classified(j, [(F.col("_i").isNotNull(), "net"), (F.col("_p").isNull(), "miss"), (F.col("object_name").endswith("blk_0000"), "pg_skip")], ok="port", name="kind").select("worker_id", "object_name", "kind")


# merges


@R("ag40_first_wins", "select text, min(doc_id) as doc_id, count(*) - 1 as n_dropped from documents where text is not null group by text")
def _(spark, d):
    return J.first_of(table(spark, d, "documents", "text", "doc_id").where("text is not null"), ["text"], ["doc_id"])


@R("ag41_range_union", """select user_id, min(value) as lo, max(value) as hi, coalesce(bool_or(event_type = 'error'), false) as failed, arg_min(event_type, event_id) filter (event_type <> 'view') as source, coalesce(min(case when event_type <> 'view' then event_type end) < max(case when event_type <> 'view' then event_type end), false) as multi_source from events group by user_id""")
def _(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").select("event_id", "user_id", F.col("value").alias("lo"), F.col("value").alias("hi"), (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("source"))
    return J.range_union(e, ["user_id"], ["lo"], ["hi"], ["failed"], "source", ["event_id"])


@R("ag42_first_by_file", """with x as (select l_partkey inst, l_linenumber pin, year(l_shipdate) f, l_orderkey o, l_suppkey s, l_quantity v from lineitem), r as (select *, row_number() over (partition by inst, pin order by f, o, s, v) n from x),
c as (select inst, pin, count(*) filter (f <> m) as k from (select *, min(f) over (partition by inst, pin) m from x) group by 1, 2)
select r.inst, r.pin, f as file, o, s, v, c.k as n_conflicts from r join c on r.inst = c.inst and r.pin = c.pin where n = 1""")
def _(spark, d):
    x = table(spark, d, LI, "l_partkey", "l_linenumber", "l_shipdate", "l_orderkey", "l_suppkey", "l_quantity").select(F.col("l_partkey").alias("inst"), F.col("l_linenumber").alias("pin"), F.year("l_shipdate").cast("bigint").alias("file"), F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("v"))
    return J.first_by_file(x, ["inst", "pin"], "file", ["o", "s", "v"])


@R("ag43_priority_merge", """with c as (select 'clk' || s_nationkey as name, case when s_suppkey % 3 = 0 then 0 else 1 end pr, s_suppkey k, floor(s_acctbal / 2500) as period, s_nationkey % 4 as edge from supplier), f as (select *, row_number() over (partition by name order by pr, k) n from c)
select a.name, any_value(a.period) as period, any_value(a.edge) as edge, count(*) filter (c.period <> a.period or c.edge <> a.edge) as n_conflicts from f a join c on a.name = c.name where a.n = 1 group by a.name""")
def _(spark, d):
    c = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.concat(F.lit("clk"), F.col("s_nationkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1).alias("pr"), F.col("s_suppkey").alias("k"), F.floor(F.col("s_acctbal") / 2500).cast("double").alias("period"), (F.col("s_nationkey") % 4).alias("edge"))
    return J.priority_merge(c, "name", "pr", ["k"], ["period", "edge"])


@R("ag47_role_counts", "select object_name, count(*) filter (direction = 'w' and duration_ms > 20) as hybrid, count(*) filter (direction = 'w' and not duration_ms > 20) as driver, count(*) filter (direction <> 'w' and duration_ms > 20) as receiver, count(*) filter (bytes is null) as unknown from object_io group by object_name")
def _(spark, d):
    return J.role_counts(table(spark, d, IO, "object_name", "direction", "duration_ms", "bytes"), "object_name", F.col("direction") == "w", F.col("duration_ms") > 20, {"unknown": F.col("bytes").isNull()})


@R("ag20_two_level_counters", "select module, status, count(*) as n, cast(sum(coalesce(read_bytes, 0)) as bigint) as read_bytes, grouping(module) + grouping(status) as level from tasks group by rollup (module, status)")
def _(spark, d):
    t = table(spark, d, T, "module", "status", "read_bytes").rollup("module", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("read_bytes", F.lit(0))).alias("read_bytes"), (F.grouping("module") + F.grouping("status")).cast("bigint").alias("level"))
    return t


@R("ag59_run_rules", "with c as (select module, count(*) n, count(*) filter (status = 'FAILED') f, count(*) filter (status = 'COMPLETED') h from tasks group by 1) select module, case when f = n then 'fatal' when h = 0 then 'warning' when f > 0 then 'note' else 'ok' end as verdict, f as n_failed from c")
def _(spark, d):
    c = table(spark, d, T, "module", "status").groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "FAILED").alias("f"), F.count_if(F.col("status") == "COMPLETED").alias("h"))
    return J.classified(c, [(F.col("f") == F.col("n"), "fatal"), (F.col("h") == 0, "warning"), (F.col("f") > 0, "note")], name="verdict").select("module", "verdict", F.col("f").alias("n_failed"))


# sets


@R("st01_bag_concat", "select worker_id, epoch_ms, max(coalesce(proc_rss_bytes, 0)) % 1000000007 as rss from (select worker_id, epoch_ms, proc_rss_bytes from worker_samples where kind = 0 union all select worker_id, epoch_ms, proc_rss_bytes from worker_samples where kind = 1) group by 1, 2")
def _(spark, d):
    s = table(spark, d, SA, "worker_id", "epoch_ms", "proc_rss_bytes", "kind")
    return s.where("kind = 0").unionByName(s.where("kind = 1")).groupBy("worker_id", "epoch_ms").agg((F.max(F.coalesce("proc_rss_bytes", F.lit(0))) % 1000000007).alias("rss"))


@R("st02_distinct", "select distinct worker_id, role from workers")
def _(spark, d):
    return table(spark, d, W, "worker_id", "role").distinct()


@R("st03_union", "select worker_id from tasks where worker_id is not null union select worker_id from worker_samples union select worker_id from object_io where worker_id is not null")
@R("st05_key_union", "select worker_id from tasks where worker_id is not null union select worker_id from worker_samples union select worker_id from object_io where worker_id is not null")
def _(spark, d):
    part = lambda t: table(spark, d, t, "worker_id").where("worker_id is not null").distinct()
    return part(T).union(part(SA)).union(part(IO)).distinct()


# word counts

WORDS = r"with w as (select unnest(regexp_split_to_array(lower(text), '\s+')) w from documents) select w as word, count(*) as n from w where w <> '' group by w"


@R("ag10_word_count", WORDS)
@R("tk08_word_order", WORDS + " order by n desc, word")
def _(spark, d):
    return M.word_counts(table(spark, d, "documents", "text"), "text")


QUERIES["tk08_word_order"] = lambda spark, d: M.word_counts(table(spark, d, "documents", "text"), "text").orderBy(F.desc("n"), "word")


def _by_functions(spark: SparkSession, d: str, kind: str) -> DataFrame:
    mr = M.MapReduce(spark).set_pre_partitioned(table(spark, d, "documents", "lang"))
    count = lambda rows: {k: sum((r["lang"] or "none") == k for r in rows) for k in {r["lang"] or "none" for r in rows}}
    add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}
    got = mr.set_processor(count).set_merger(add, kind).set_finalizer(lambda v: sorted(v.items())).run().get()
    return spark.createDataFrame(got or [], "lang string, n bigint")


LANGS = "select coalesce(lang, 'none') as lang, count(*) as n from documents group by 1"


@R("ag12_full_merge", LANGS)
def _(spark, d):
    return _by_functions(spark, d, "full")


@R("ud02_mapreduce", LANGS)
def _(spark, d):
    return _by_functions(spark, d, "summary")


# lookup tables: a price grid by size and brand group



@R("fn14_interpolate", """with q as (select l_linenumber, l_quantity x, l_discount * 100 y from (select distinct l_linenumber, l_quantity, l_discount from lineitem)), c as (select *, greatest(least(x, 40.0), 0.0) cx, greatest(least(y, 8.0), 0.0) cy from q),
b as (select *, case when cx > 10 then 10 else 0 end x0, case when cx > 10 then 40 else 10 end x1, case when cy > 2 then 2 else 0 end y0, case when cy > 2 then 8 else 2 end y1 from c)
select l_linenumber, x, round(y, 6) as y, round(((x0 * 3 + y0 * 5) * (x1 - cx) * (y1 - cy) + (x1 * 3 + y0 * 5) * (cx - x0) * (y1 - cy) + (x0 * 3 + y1 * 5) * (x1 - cx) * (cy - y0) + (x1 * 3 + y1 * 5) * (cx - x0) * (cy - y0)) / ((x1 - x0) * (y1 - y0)), 6) as v from b""")
def _(spark, d):
    q = table(spark, d, LI, "l_linenumber", "l_quantity", "l_discount").distinct().select("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    xs, ys = [0.0, 10.0, 40.0], [0.0, 2.0, 8.0]
    axes = [F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))]
    v = L.interpolate(axes, F.array(*(F.lit(a * 3 + b * 5) for a in xs for b in ys)), [F.col("x"), F.col("y")])
    return q.select("l_linenumber", "x", F.round("y", 6).alias("y"), F.round(v, 6).alias("v"))


@R("jn23_templates", """with t as (select p_brand k, list(p_size order by p_size) ax from (select distinct p_brand, p_size from part where p_type = 'ECONOMY') group by 1), u as (select p_brand k, p_type ty, case when p_type = 'STANDARD' then list(p_size order by p_size) end ax, list(p_size order by p_size) vals from (select distinct p_brand, p_type, p_size from part) group by p_brand, p_type)
select u.k, u.ty as type, coalesce(len(coalesce(u.ax, t.ax)), 0) as n_axis, coalesce(len(coalesce(u.ax, t.ax)) = len(u.vals), false) as ready from u left join t on u.k = t.k""")
def _(spark, d):
    p = table(spark, d, "part", "p_brand", "p_type", "p_size").distinct()
    axis = F.array_sort(F.collect_list(F.col("p_size").cast("double")))
    t = p.where("p_type = 'ECONOMY'").groupBy(F.col("p_brand").alias("k")).agg(axis.alias("ax"))
    u = p.groupBy(F.col("p_brand").alias("k"), F.col("p_type").alias("type")).agg(axis.alias("values")).withColumn("ax", F.when(F.col("type") == "STANDARD", F.col("values")))
    return L.with_template(u, t, "k", ["ax"]).select("k", "type", F.coalesce(F.size("ax"), F.lit(0)).cast("bigint").alias("n_axis"), "ready")


# scalar functions


@R("fn01_path_segments", "select object_name, len(string_split(object_name, '/')) as n, array_to_string(list_filter(string_split(object_name, '/'), lambda x: x <> ''), '/') as joined from (select distinct object_name from object_io)")
def _(spark, d):
    return table(spark, d, IO, "object_name").distinct().select("object_name", F.size(S.segments("object_name")).cast("bigint").alias("n"), S.joined(S.segments("object_name")).alias("joined"))


@R("fn02_strip_prefix", "select object_name, case when object_name like '/runs/%' and len(object_name) > 6 then object_name[7:] end as rest, cast(null as varchar) as missed from (select distinct object_name from object_io)")
def _(spark, d):
    return table(spark, d, IO, "object_name").distinct().select("object_name", S.strip_prefix("object_name", ["", "runs"]).alias("rest"), S.strip_prefix("object_name", ["", "other"]).alias("missed"))


@R("fn03_last_segment", "select object_name, string_split(object_name, '/')[-1] as leaf from (select distinct object_name from object_io)")
def _(spark, d):
    return table(spark, d, IO, "object_name").distinct().select("object_name", S.last_segment("object_name").alias("leaf"))


@R("fn04_domain", "select name, case when contains(k, '::') then split_part(k, '::', 1) else '' end as domain from (select distinct name, coalesce(module || '::', '') || name k from tasks)")
def _(spark, d):
    k = F.concat(F.coalesce(F.concat("module", F.lit("::")), F.lit("")), "name")
    return table(spark, d, T, "module", "name").select("name", k.alias("k")).distinct().select("name", S.domain("k").alias("domain"))


@R("fn05_ranges", """with s as (select event_id, case event_type when 'view' then '*' when 'error' then 'x:1' when 'click' then value || ':' || (value + 1) else cast(value as varchar) end r, event_type e, value v from events)
select event_id, case e when 'click' then v when 'view' then null when 'error' then null else v end as lo, case e when 'click' then v + 1 when 'view' then null when 'error' then null else v end as hi, case e when 'view' then 'no' when 'error' then 'bad' else 'yes' end as present from s""")
def _(spark, d):
    v = F.col("value")
    r = F.when(F.col("event_type") == "view", "*").when(F.col("event_type") == "error", "x:1").when(F.col("event_type") == "click", F.concat(v.cast("string"), F.lit(":"), (v + 1).cast("string"))).otherwise(v.cast("string"))
    e = table(spark, d, "events", "event_id", "event_type", "value").select("event_id", S.number_range(r).alias("r"))
    return e.select("event_id", F.col("r.min").alias("lo"), F.col("r.max").alias("hi"), F.when(F.col("r").isNull(), "bad").when(F.col("r.present"), "yes").otherwise("no").alias("present"))


@R("fn06_units", "select event_id, cast(round(value * 1000, 0) as bigint) as units, cast(round(-value * 4, 0) as bigint) as negative from events")
def _(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", S.to_units("value").alias("units"), S.to_units(-F.col("value"), 4.0).alias("negative"))


@R("fn07_floor_div", "select o_orderkey, cast(floor((o_custkey - 700) / 7.0) as bigint) as q from orders")
def _(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", S.floor_div(F.col("o_custkey") - 700, 7).alias("q"))


@R("fn08_enum", "select distinct role, case role when 'compute' then 0 when 'storage' then 1 when 'master' then 2 else 9 end as code, coalesce(role in ('compute', 'storage', 'master'), false) as known from workers")
def _(spark, d):
    r = F.col("role")
    code = F.when(r == "compute", 0).when(r == "storage", 1).when(r == "master", 2).otherwise(9)
    return table(spark, d, W, "role").distinct().select("role", code.alias("code"), F.coalesce(r.isin("compute", "storage", "master"), F.lit(False)).alias("known"))


@R("fn15_fnv1a", "with recursive n as (select distinct name from tasks), h as (select name, 0 i, cast(2166136261 as bigint) h from n union all select name, i + 1, xor(h, cast(ord(name[i + 1]) as bigint)) * 16777619 % 4294967296 from h where i < len(name)) select name, h % 65536 as bucket from h where i = len(name)")
def _(spark, d):
    return table(spark, d, T, "name").distinct().select("name", S.fnv1a("name").alias("bucket"))


@R("fn16_uid", "select distinct object_name, substr(sha256(object_name), 1, 12) as uid from object_io")
def _(spark, d):
    return table(spark, d, IO, "object_name").distinct().select("object_name", S.uid("object_name").alias("uid"))


@R("fn17_seconds", "select worker_id, epoch_ms, epoch_ms // 1000 as second from worker_samples")
def _(spark, d):
    return table(spark, d, SA, "worker_id", "epoch_ms").select("worker_id", "epoch_ms", S.second("epoch_ms").alias("second"))


@R("fn18_sizes", "select id, case when b < 1048576 then b // 1024 || 'KB' when b < 1073741824 then b // 1048576 || 'MB' else printf('%.1fGB', b / 1073741824.0) end as size from (select id, bytes * 50 b from object_io where bytes is not null)")
def _(spark, d):
    return table(spark, d, IO, "id", "bytes").where("bytes is not null").select("id", S.size_text(F.col("bytes") * 50).alias("size"))


@R("fn19_unescape", r"select distinct object_name, regexp_replace(replace(object_name, ':', '\:'), '\\(.)', '\1', 'g') as plain from object_io")
def _(spark, d):
    return table(spark, d, IO, "object_name").distinct().select("object_name", S.unescaped(F.regexp_replace("object_name", ":", r"\\:")).alias("plain"))


@R("fn20_grid_spec", "select distinct p_size, case when p_size % 4 > 0 then p_size % 4 end as x, case when p_size % 4 > 0 then p_size end as y from part")
def _(spark, d):
    p = table(spark, d, "part", "p_size").distinct().withColumn("g", S.grid_spec(F.concat((F.col("p_size") % 4).cast("string"), F.lit("x"), F.col("p_size").cast("string"))))
    return p.select("p_size", "g.x", "g.y")


# point queries


@R("pq01_cell_with_pins", "select p_brand, count(*) as n_pins, list(p_partkey order by p_partkey)[1] as first_pin, max(p_size) as height from part group by p_brand")
def _(spark, d):
    return table(spark, d, "part", "p_brand", "p_partkey", "p_size").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_pins"), F.min("p_partkey").alias("first_pin"), F.max("p_size").alias("height"))


@R("pq04_layer", "select r_regionkey, r_name from region where r_name = 'ASIA'")
def _(spark, d):
    return table(spark, d, "region", "r_regionkey", "r_name").where("r_name = 'ASIA'")


@R("pq06_timing_of", "select t.worker_id, t.task_id, t.exec_start_ms, w.role from tasks t join (select distinct worker_id, role from workers) w on t.worker_id = w.worker_id where t.exec_start_ms > 0")
def _(spark, d):
    w, _ = broadcast_if_small(table(spark, d, W, "worker_id", "role").distinct(), 500_000)
    return table(spark, d, T, "worker_id", "task_id", "exec_start_ms").where("exec_start_ms > 0").join(w, "worker_id").select("worker_id", "task_id", "exec_start_ms", "role")
