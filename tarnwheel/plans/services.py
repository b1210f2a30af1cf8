"""Queries over scheduling, ids, sinks, arrivals, large files, stored matrices, the API and resumed flows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapreduce as M
from ..operators import merge as J
from ..operators import scheduling as W
from ..operators import solver as V
from ..sources import formats as X
from ..sources import ranges as G
from ..sources.api import Api, NotReady
from ..sources.catalog import provenance
from ..streaming import incremental as N
from ..session import cut, file_at, table
from .base import Register
from .flows import Flows, chained
from .relations import LOCAL, _reads_and_holders
from .systems import GRID_N, POISSON, UPSERT, _catalog, _flows, _lib, _twf, _twf_files

R = Register()
QUERIES, SQL = R.queries, R.sql


@R("ag11_tree_merge", r"select len(w) as length, count(*) as n from (select unnest(regexp_split_to_array(text, '[\t\n\f\r ]+')) w from documents) where w <> '' group by 1")
def _(spark, d):
    # counters of word lengths, made a batch at a time and added up in a tree of fan-in eight
    count = lambda rows: Counter(len(w) for r in rows for w in re.split(r"[\t\n\f\r ]+", r["text"]) if w)
    mr = M.MapReduce(spark).set_pre_partitioned(table(spark, d, "documents", "text").where("text is not null"))
    got = mr.set_processor(count).set_merger(lambda a, b: a + b).set_finalizer(lambda v: sorted(v.items())).run().get()
    return spark.createDataFrame(got or [], "length bigint, n bigint")


NEEDS = {0: [], 1: ["gpu=0"], 2: ["slots=4", "zone=b"], 3: ["slots=8", "zone=q"], 4: ["none"]}


@R("tk06_worker_choice", LOCAL + """, w as (select worker_id, max(coalesce(attributes, '')) a, min(coalesce(first_seen_ms, 0)) o from workers where worker_id is not null group by 1),
k(k, needs) as (values (0, []::varchar[]), (1, ['gpu=0']), (2, ['slots=4', 'zone=b']), (3, ['slots=8', 'zone=q']), (4, ['none'])), t as (select distinct task_id, task_id % 5 k, task_id % 3 <> 0 may from tasks where task_id is not null),
m as (select k, worker_id, o, len(list_filter(needs, lambda x: list_contains(string_split(a, ';'), x))) matched, len(needs) size from k, w),
f as (select k, worker_id from (select *, row_number() over (partition by k order by o, worker_id) n from m where matched = size) where n = 1), g as (select k, worker_id from (select *, row_number() over (partition by k order by matched desc, o, worker_id) n from m) where n = 1),
b as (select k, max(matched) best from m group by k), l as (select task_id, worker_id from (select t.task_id, s.worker_id, row_number() over (partition by t.task_id order by bytes desc, s.worker_id) n from s join t on s.task_id = t.task_id join b on b.k = t.k left join m on m.k = t.k and m.worker_id = s.worker_id where coalesce(matched, 0) = best and bytes > 0) where n = 1)
select t.task_id, case when f.worker_id is not null then f.worker_id when not may then null else coalesce(l.worker_id, g.worker_id) end as worker_id, case when f.worker_id is not null then 'full' when not may then 'wait' when l.worker_id is not null then 'local' else 'degraded' end as how
from t left join f on t.k = f.k left join l on t.task_id = l.task_id left join g on t.k = g.k""")
def _(spark, d):
    needs = None
    for k, v in NEEDS.items():
        x = F.array(*map(F.lit, v)).cast("array<string>")
        needs = F.when(F.col("task_id") % 5 == k, x) if needs is None else needs.when(F.col("task_id") % 5 == k, x)
    t = table(spark, d, "tasks", "task_id").where("task_id is not null").distinct().select(F.col("task_id").alias("task"), needs.alias("needs"), (F.col("task_id") % 3 != 0).alias("may_degrade"))
    w = table(spark, d, "workers", "worker_id", "attributes", "first_seen_ms").where("worker_id is not null").groupBy(F.col("worker_id").alias("worker")).agg(F.max(F.coalesce("attributes", F.lit(""))).alias("a"), F.min(F.coalesce("first_seen_ms", F.lit(0))).alias("idle_order"))
    reads, holders = _reads_and_holders(spark, d)
    return W.choose_workers(t, w.select("worker", F.split("a", ";").alias("has"), "idle_order"), reads=reads, holders=holders).select(F.col("task").alias("task_id"), F.col("worker").alias("worker_id"), "how")


@R("jn27_renumber", """with f as (select object_name n, min(id) o from object_io where object_name is not null group by 1), g as (select n, o, case when o % 3 <> 0 then o % 997 end g from f), c as (select *, g is not null and row_number() over (partition by g order by o, n) = 1 kept from g),
ids as (select n, g as id, kept from c where kept union all select n, (select max(g) from g) + row_number() over (order by o, n), kept from c where not kept) select io.id, ids.id as object_id, ids.kept from object_io io left join ids on io.object_name = ids.n""")
def _(spark, d):
    # two thirds of the names come with an id, many of them with one that another name has
    io = table(spark, d, "object_io", "id", "object_name")
    given = io.where("object_name is not null").groupBy("object_name").agg(F.min("id").alias("o")).withColumn("given", F.when(F.col("o") % 3 != 0, F.col("o") % 997))
    ids = J.renumbered(given, "object_name", "given", ["o"])
    kept = io.join(ids.select("object_name", "kept"), "object_name", "left")
    return J.rewritten(kept, "object_name", ids, "object_name").select("id", F.col("object_name").alias("object_id"), "kept")


@R("ag58_per_file_tables", "select 'f' || user_id // 20 as file, count(*) as n_entries, count(distinct case when user_id % 5 < 4 then user_id % 5 end) as n_clocks from events where event_type <> 'error' group by 1")
def _(spark, d):
    # chunks of each file, put together again
    return X.entries(_twf(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("clock").alias("n_clocks"))


def _filed(spark: SparkSession, df: DataFrame, name: str, files: int = 4) -> str:
    """A folder with a table of the given number of files."""
    folder = N.folder_of(spark, "filed")
    df.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


@R("sm05_micro_batches", f"select *, 4::bigint as n_batches from ({UPSERT})")
def _(spark, d):
    folder = _filed(spark, table(spark, d, "tasks", "task_id", "created_ms"), "tasks")
    s = N.stream(spark, folder, "tasks", max_files=1)
    up = N.Upserts(spark, s.schema, ["task_id"], ["created_ms"])
    n = N.paced(s, up, "500 milliseconds")
    return up.table().withColumn("n_batches", F.lit(n).cast("bigint"))


@R("sm06_source_cadence", "select worker_id, epoch_ms // 10000 as report, count(distinct epoch_ms // 200) as n_samples from worker_samples where worker_id is not null and epoch_ms is not null group by all")
def _(spark, d):
    # one sample for each 200 ms of a worker goes on, in reports of ten seconds
    s = N.stream(spark, d, "worker_samples").select("worker_id", F.expr("epoch_ms div 200").alias("slot")).where("worker_id is not null and slot is not null")
    return N.drained(N.append_once(s, ["worker_id", "slot"])).groupBy("worker_id", F.expr("slot div 50").alias("report")).agg(F.count(F.lit(1)).alias("n_samples"))


@R("sm09_ready_tasks", "with w as (select distinct object_name from object_io where direction = 'w'), r as (select distinct task_id, object_name from object_io where direction = 'r') select task_id, count(*) as n_inputs, count(*) filter (w.object_name is null) as n_missing, case when count(*) filter (w.object_name is null) = 0 then 'READY' else 'PENDING' end as state from r left join w on r.object_name = w.object_name group by task_id")
def _(spark, d):
    io = table(spark, d, "object_io", "id", "epoch_ms", "task_id", "object_name", "direction")
    folder = _filed(spark, io.where("direction = 'w'").select(F.col("object_name").alias("object"), F.col("epoch_ms").alias("at"), F.lit(True).alias("present")), "written", 3)
    inputs = cut(io.where("direction = 'r'").select(F.col("task_id").alias("task"), F.col("object_name").alias("object")).distinct())
    a = N.Arrivals(spark, inputs)
    N.drain(N.stream(spark, folder, "written", max_files=1), a)
    return a.table().select(F.col("task").alias("task_id"), "n_inputs", "n_missing", F.when(F.col("ready"), "READY").otherwise("PENDING").alias("state"))


@R("sm10_availability", """with s as (select task_id, bool_or(status = 'COMPLETED') done, bool_or(status in ('PENDING', 'RUNNING')) live from tasks group by 1),
o as (select object_name, bool_or(coalesce(done, false)) done, bool_or(coalesce(live, false)) live from object_io i left join s on i.task_id = s.task_id where direction = 'w' group by 1), r as (select distinct object_name from object_io where direction = 'r')
select r.object_name, case when done then 'available' when live then 'wait' else 'never' end as verdict from r left join o on r.object_name = o.object_name""")
def _(spark, d):
    # the first look finds no task done; three more find the tables as they are
    t = table(spark, d, "tasks", "task_id", "status").groupBy("task_id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("done"), F.bool_or(F.col("status").isin("PENDING", "RUNNING")).alias("live"))
    io = table(spark, d, "object_io", "task_id", "object_name", "direction")
    no = F.lit(False)
    o = io.where("direction = 'w'").join(t, "task_id", "left").groupBy(F.col("object_name").alias("name")).agg(F.bool_or(F.coalesce("done", no)).alias("done"), F.bool_or(F.coalesce("live", no)).alias("live"))
    o = cut(o.select("name", F.when(F.col("done"), "available").when(F.col("live"), "wait").otherwise("never").alias("verdict")))
    waiting = N.Waiting(io.where("direction = 'r'").select(F.col("object_name").alias("name")))
    waiting.look(o.withColumn("verdict", F.lit("wait")))
    for _ in range(waiting.confirm):
        waiting.look(o)
    return waiting.state.select(F.col("name").alias("object_name"), "verdict")


@R("ud09_udtf", "select 'e' || event_id as name, case when user_id % 5 < 4 then 'clk' || user_id % 5 end as clock from events where event_type <> 'error'")
def _(spark, d):
    parse = X.parser("twf")
    t = _twf_files(spark, d).lateralJoin(parse(F.col("text").outer()))
    return t.where("kind = 'entry'").select("name", F.col("attrs")["clock"].alias("clock"))


def _on_disk(spark: SparkSession, files: DataFrame) -> list[str]:
    """Paths of the texts, written one file each to the shared folder; they come from one test table and are few."""
    folder = N.folder_of(spark, "texts")
    system, at = file_at(folder)
    system.create_dir(at)
    names = sorted(r["file"] for r in files.select("file").collect())

    def write(batches):
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, p = file_at(f"{folder}/{name}")
                with fs.open_output_stream(p) as f:
                    f.write(text.encode())
            yield b.select([0])

    files.select("file", "text").mapInArrow(write, "file string").count()
    return [f"{folder}/{n}" for n in names]


@R("sc19_byte_ranges", "select 'e' || event_id as name, case when user_id % 5 < 4 then 'clk' || user_id % 5 end as clock from events where event_type <> 'error'")
def _(spark, d):
    rows = G.read_ranges(spark, _on_disk(spark, _twf_files(spark, d)), "twf", 50_000)
    return X.entries(rows).select("name", "clock")


@R("sc21_matrix_source", f"with {POISSON} select i, j, v from a")
def _(spark, d):
    line = 2 * np.eye(GRID_N) - np.eye(GRID_N, k=1) - np.eye(GRID_N, k=-1)
    i, j = np.nonzero(m := np.kron(line, np.eye(GRID_N)) + np.kron(np.eye(GRID_N), line))
    path = N.folder_of(spark, "matrix") + ".npz"
    system, at = file_at(path)
    with system.open_output_stream(at) as f:
        np.savez(f, row=i, col=j, data=m[i, j])
    return V.stored_matrix(spark, path)


@R("sc22_metrics_sink", "select 'upsert' as kind, count(*) as n, sum(v) as total from (select task_id, max(created_ms) % 1000 v from tasks group by 1) union all select 'ignore', count(*), null from (select distinct worker_id from workers) union all select 'append', count(*), sum(id % 1000) from object_io")
def _(spark, d):
    sink = N.MetricsSink(spark)
    t, w, io = N.stream(spark, d, "tasks").select("task_id", "created_ms"), N.stream(spark, d, "workers").select("worker_id", "hostname"), N.stream(spark, d, "object_io").select("id")
    up, first = sink.upsert("tasks", t.schema, ["task_id"], ["created_ms"]), sink.ignore("workers", w.schema, ["worker_id"])
    for s, f in ((t, up), (w, first), (io, sink.append("io"))):
        N.drain(s, f)
    part = lambda kind, df, v: df.agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")).select(F.lit(kind).alias("kind"), "n", F.col("total").cast("decimal(38,0)").cast("bigint").alias("total"))
    return part("upsert", up.table(), F.col("created_ms") % 1000).unionByName(part("ignore", first.table(), F.lit(None).cast("bigint"))).unionByName(part("append", sink.appended("io", io.schema), F.col("id") % 1000))


@R("sc24_json_rows", """select '/tasks/' || status as path, 200 as code, '[{"status": "' || status || '", "n": ' || count(*) || '}]' as body from tasks where status is not null group by status
union all values ('/tasks/NONE', 404, '{"error": "not found: NONE"}'), ('/later', 503, '{"error": "not yet"}'), ('/broken', 500, '{"error": "ValueError: broken"}'), ('/nothing', 404, '{"error": "no such path: /nothing"}')""")
def _(spark, d):
    api = Api()
    counts = table(spark, d, "tasks", "status").where("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    @api.route("/tasks/{status}")
    def by_status(status: str) -> DataFrame:
        found = counts.where(F.col("status") == status)
        if found.isEmpty():
            raise KeyError(status)
        return found

    @api.route("/later")
    def later() -> None:
        raise NotReady("not yet")

    @api.route("/broken")
    def broken() -> None:
        raise ValueError("broken")

    known = [r["status"] for r in counts.select("status").collect()]  # a status of five
    paths = [*(f"/tasks/{s}" for s in known), "/tasks/NONE", "/later", "/broken", "/nothing"]
    return spark.createDataFrame([(p, *api.get(p)) for p in paths], "path string, code int, body string")


@R("pq09_find_cell", "select 'cell' as kind, 'P7' as name from part where p_partkey = 7 union all select 'lu_table_template', 't1' from (select 1 from part limit 1)")
def _(spark, d):
    rows = _lib(spark, d)
    return X.find(rows, "cell", "P7").unionByName(X.find(rows, "lu_table_template", "t1")).select("kind", "name").distinct()


@R("pq03_net_roles", "select object_name, count(distinct worker_id) as n_workers, case when object_name like '%blk_0000' then null else coalesce(array_to_string(list_sort(list(distinct worker_id) filter (worker_id is not null)), ','), '') end as workers from object_io group by object_name")
def _(spark, d):
    # connections are not told for the nets that would have too many
    g = table(spark, d, "object_io", "object_name", "worker_id").groupBy("object_name").agg(F.count_distinct("worker_id").alias("n_workers"), F.array_sort(F.collect_set(F.when(~F.col("object_name").endswith("blk_0000"), F.col("worker_id")))).alias("w"))
    return g.select("object_name", "n_workers", F.when(~F.col("object_name").endswith("blk_0000"), F.array_join(F.col("w").cast("array<string>"), ",")).alias("workers"))


@R("ud04_registered_flow", "select * from (values ('by_customer', 'open_orders', 1::bigint), ('open_orders', 'orders', 0)) t(flow, needs, place)")
def _(spark, d):
    order = _flows.order("by_customer", frozenset(["orders"]))
    return spark.createDataFrame([(n, ",".join(_flows.flows[n][1]), k) for k, n in enumerate(order)], "flow string, needs string, place bigint")


@R("ud06_handlers", "select l_returnflag, count(*) as n from lineitem where l_quantity > 10 and l_discount < 0.05 group by l_returnflag")
def _(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    return chained(li, lambda x: x.where("l_quantity > 10"), lambda x: x.where("l_discount < 0.05"), lambda x: x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))


@R("sc26_existing_partitions", "select o_orderpriority, count(*) as n from orders where o_orderstatus in ('F', 'O', 'P') group by 1")
def _(spark, d):
    # datasets that are there already are the partitions
    db = _catalog(spark).create("parts")
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    for s in "FOP":
        db.write(s, o.where(F.col("o_orderstatus") == s).select("o_orderpriority"))
    mr = M.MapReduce(spark).set_pre_partitioned(*(db.read(s) for s in "FOP")).set_processor(lambda rows: Counter(r["o_orderpriority"] for r in rows)).set_merger(lambda a, b: a + b)
    return spark.createDataFrame(sorted((mr.run().get() or {}).items()), "o_orderpriority string, n bigint")


@R("ag13_finalizer", "select coalesce(lang, 'none') as lang, count(*) as n from documents group by 1")
def _(spark, d):
    # the finalizer copies the merged value to a dataset
    db = _catalog(spark).create("final")

    def store(v: Counter) -> str:
        db.write("langs", spark.createDataFrame(sorted(v.items()), "lang string, n bigint"))
        return "langs"

    mr = M.MapReduce(spark).set_pre_partitioned(table(spark, d, "documents", "lang")).set_processor(lambda rows: Counter(r["lang"] or "none" for r in rows)).set_merger(lambda a, b: a + b)
    return db.read(mr.set_finalizer(store).run().get())


@R("su04_resumed_flow", "select o_custkey, count(*) as n, 1::bigint as n_runs_of_first from orders where o_orderstatus = 'O' group by 1 having count(*) > 1")
def _(spark, d):
    # the second flow fails once; the run after it goes on behind the first one
    flows, db, runs = Flows(), _catalog(spark).create("resumed"), []

    @flows.flow("open", ("orders",))
    def first(orders: DataFrame) -> DataFrame:
        runs.append("open")
        return orders.where("o_orderstatus = 'O'")

    @flows.flow("counted", ("open",))
    def second(orders: DataFrame) -> DataFrame:
        runs.append("counted")
        if runs.count("counted") == 1:
            raise RuntimeError("lost")
        return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    given = {"orders": table(spark, d, "orders", "o_custkey", "o_orderstatus")}
    try:
        flows.resume("counted", db, given, d)
    except RuntimeError:
        pass
    out = flows.resume("counted", db, given, d)
    return out.withColumn("n_runs_of_first", F.lit(runs.count("open")).cast("bigint"))


@R("su05_provenance", "select * from (values ('first', 'written'), ('same', 'passed over'), ('other', 'refused')) t(attempt, outcome)")
def _(spark, d):
    db, out = _catalog(spark).create("proven"), []
    for attempt, code in (("first", "v1"), ("same", "v1"), ("other", "v2")):
        try:
            out.append((attempt, "written" if db.write("nation", table(spark, d, "nation"), provenance(code, "nation")) else "passed over"))
        except ValueError:
            out.append((attempt, "refused"))
    return spark.createDataFrame(out, "attempt string, outcome string")
