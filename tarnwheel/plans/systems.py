"""Queries over the catalogue, the text formats, the streams and the solver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as C
from ..operators import hierarchy as H
from ..operators import ordered as O
from ..operators import solver as V
from ..sources import formats as X
from ..sources.catalog import Catalog, provenance
from ..streaming import incremental as N
from ..session import table
from .base import Register
from .flows import Flows, chained

R = Register()
QUERIES, SQL = R.queries, R.sql


# catalogue: databases in the shared folder


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, N.folder_of(spark, "catalog"))


@R("sc01_read_object", "select n_name, count(*) as n from nation join customer on n_nationkey = c_nationkey group by n_name")
def _(spark, d):
    db = _catalog(spark).create("star", role="design")
    db.write("customers", table(spark, d, "customer", "c_nationkey"), provenance("customer", d))
    return db.read("customers").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@R("sc02_write_once", "select 'same' as second_write, count(*) as n from orders")
def _(spark, d):
    db = _catalog(spark).create("runs")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    db.write("orders", o, "v1")
    again = db.write("orders", o.limit(1), "v1")  # the same provenance: passed over
    return db.read("orders").agg(F.count(F.lit(1)).alias("n")).select(F.lit("written" if again else "same").alias("second_write"), "n")


@R("sc05_vars", "select n_regionkey, 0.5::double * count(*) as scaled from nation group by n_regionkey")
def _(spark, d):
    db = _catalog(spark).create("settings")
    db.set_var("scale", 0.5)
    return table(spark, d, "nation", "n_regionkey").groupBy("n_regionkey").agg((F.lit(db.get_var("scale")) * F.count(F.lit(1))).alias("scaled"))


@R("sc10_freeze", "select r_regionkey, r_name from region")
def _(spark, d):
    db = _catalog(spark).create("frozen")
    db.write("region", table(spark, d, "region"))
    db.write_temp("scratch", table(spark, d, "nation"))
    db.freeze()
    if db.names() != ["region"]:
        raise RuntimeError("a temporary dataset outlived the freeze")
    return db.read("region")


@R("sc11_merge", "select worker_id, epoch_ms from worker_samples")
def _(spark, d):
    c = _catalog(spark)
    s = table(spark, d, "worker_samples", "worker_id", "epoch_ms", "kind")
    shards = []
    for k in (0, 1):
        db = c.create(f"shard{k}")
        db.write("samples", s.where(F.col("kind") == k))
        shards.append(db)
    return c.merge("whole", shards).read("samples").select("worker_id", "epoch_ms")


@R("sc27_partition_scan", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def _(spark, d):
    db = _catalog(spark).create("parts")
    db.write("orders", table(spark, d, "orders", "o_orderkey", "o_orderstatus"), partition_by=["o_orderstatus"])
    return db.read("orders", "o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@R("pq08_status", "select * from (values ('base', 'design', 1), ('next', 'timing', 2)) t(name, role, n_datasets)")
def _(spark, d):
    c = _catalog(spark)
    a = c.create("base", role="design")
    a.write("region", table(spark, d, "region"))
    b = c.create("next", role="timing").after(a)
    b.write("nation", table(spark, d, "nation"))
    b.write("customer", table(spark, d, "customer"))
    return c.status().select("name", "role", "n_datasets")


@R("sc25_text_summary", "select 'worker ' || worker_id || ': ' || count(*) || ' samples' as line from worker_samples group by worker_id")
def _(spark, d):
    out = N.folder_of(spark, "summary")
    s = table(spark, d, "worker_samples", "worker_id").groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"))
    s.select(F.concat(F.lit("worker "), F.col("worker_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" samples"))).write.text(out)
    return spark.read.text(out).withColumnRenamed("value", "line")


# text formats: written from the tables, read back


def _files(df: DataFrame, key: str, body: str, order: str, head: str, tail: str, per: int = 500) -> DataFrame:
    """(file, text) with the constructs of at most `per` keys each."""
    g = df.groupBy(F.call_function("div", F.col(key), F.lit(per)).alias("f")).agg(F.array_sort(F.collect_list(F.struct(order, F.col(body).alias("b")))).alias("x"))
    return g.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), F.concat(F.lit(head), F.array_join("x.b", "\n"), F.lit(tail)).alias("text"))


LEF_BODY = """format_string('MACRO P%d\n CLASS CORE ;\n ORIGIN 0.0 0.0 ;\n SIZE %d.5 BY %d.25 ;\n PIN A\n DIRECTION INPUT ;\n USE SIGNAL ;\n PORT\n LAYER M1 ;\n RECT 0.0 0.0 0.1 %d.2 ;\n END\n END A\nEND P%d', p_partkey, p_size, p_size % 7, p_size % 7, p_partkey)"""


def _lef(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.expr(LEF_BODY).alias("body"))
    return X.parse(_files(p, "p_partkey", "body", "p_partkey", "VERSION 5.8 ;\nLAYER M1\n TYPE ROUTING ;\n WIDTH 0.07 ;\nEND M1\n", "\nEND LIBRARY\n"), "lef")


@R("sc13_cell_lef", "select 'P' || p_partkey as name, cast(p_size * 1000 + 500 as bigint) as width, cast(p_size % 7 * 1000 + 250 as bigint) as height from part")
def _(spark, d):
    return X.macros(_lef(spark, d)).select("name", "width", "height")


@R("sc13_pin_shapes", "select 'P' || p_partkey || '/A' as parent, 'M1' as layer, cast(100 as bigint) as xh, cast(p_size % 7 * 1000 + 200 as bigint) as yh from part")
def _(spark, d):
    return X.boxes(_lef(spark, d)).select("parent", "layer", "xh", "yh")


@R("sc12_tech_lef", "select distinct 'M1' as name, 'ROUTING' as type, 70 as width, 'f' || p_partkey // 500 as file from part")
def _(spark, d):
    r = _lef(spark, d).where("kind = 'layer'")
    return r.select("name", X.attr("type"), X.attr("width", "int"), "file")


DEF_BODY = """format_string(' - c%d P%d + %s ( %d %d ) N ;', c_custkey, c_custkey % 97, case when c_nationkey = 3 then 'FIXED' else 'PLACED' end, c_custkey * 2, c_nationkey * 2 + 1)"""


def _def(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.expr(DEF_BODY).alias("body"))
    return X.parse(_files(c, "c_custkey", "body", "c_custkey", "VERSION 5.8 ;\nDESIGN blk ;\nUNITS DISTANCE MICRONS 2000 ;\nDIEAREA ( 0 0 ) ( 4000 2000 ) ;\nCOMPONENTS 500 ;\n", "\nEND COMPONENTS\nEND DESIGN\n"), "def")


@R("sc15_components", "select 'c' || c_custkey as name, 'P' || c_custkey % 97 as master, case when c_nationkey = 3 then 'FIXED' else 'PLACED' end as status, c_custkey as x, cast(c_nationkey + 1 as bigint) as y from customer")
def _(spark, d):
    return X.components(_def(spark, d)).select("name", "master", "status", "x", "y")


@R("sc14_def_header", "select distinct 'f' || c_custkey // 500 as file, 'blk' as name from customer")
def _(spark, d):
    return _def(spark, d).where("kind = 'design'").select("file", "name")


@R("sc16_nets", "select distinct 'n' || o_custkey as net, 'o' || o_orderkey as instance, 'A' as pin from orders")
def _(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").distinct()
    g = o.groupBy("o_custkey", F.call_function("div", "o_orderkey", F.lit(10_000)).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.concat(F.lit("( o"), x.cast("string"), F.lit(" A )"))), " ").alias("c"))
    n = g.select("o_custkey", F.concat(F.lit(" - n"), F.col("o_custkey").cast("string"), F.lit(" "), "c", F.lit(" + USE SIGNAL ;")).alias("body"))
    rows = X.parse(_files(n, "o_custkey", "body", "o_custkey", "VERSION 5.8 ;\nDESIGN nets ;\nNETS 500 ;\n", "\nEND NETS\nEND DESIGN\n"), "def")
    return X.connections(rows).select("net", "instance", "pin")


LIB_BODY = """format_string('  cell (P%d) { area : %d.5; pin (A) { direction : input; capacitance : 0.%d; } pin (Z) { direction : output; timing () { related_pin : "A"; cell_rise (t1) { index_1 ("0, 1"); values ("%d, %d"); } } } strange () { x : 1; } }', p_partkey, p_size, p_size % 9 + 1, p_size, p_size + 2)"""


def _lib(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.expr(LIB_BODY).alias("body"))
    files = _files(p, "p_partkey", "body", "p_partkey", '/* made here */ library (lib) {\n  lu_table_template (t1) { variable_1 : a; index_1 ("0, 1"); }\n', "\n}\n")
    return X.parse(X.split_texts(files, "liberty", 4000), "liberty")


@R("sc17_liberty_cells", "select 'P' || p_partkey as name, p_size + 0.5::double as area from part")
@R("sc19_chunked_liberty", "select 'P' || p_partkey as name, p_size + 0.5::double as area from part")
def _(spark, d):
    return X.cells(_lib(spark, d)).select("name", "area")


@R("sc17_liberty_tables", "select 'lib/P' || p_partkey || '/Z/timing1' as parent, 't1' as template, 2 as n_axis, p_size * 2 + 2.0::double as total from part")
def _(spark, d):
    t = X.tables(_lib(spark, d))
    return t.select("parent", "template", F.size("index_1").alias("n_axis"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@R("sc17_unknown_groups", "select 'strange' as name, count(*) as n from part")
def _(spark, d):
    return _lib(spark, d).where("kind = 'unknown'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


TWF_BODY = """concat('(CAUSED_BY "clk', user_id % 5, '" RISE\n', array_join(transform(array_sort(es), e -> if(e.event_type = 'error', concat('(NET "e', e.event_id, '" 1:2)'), format_string('(NET "e%d" %d:%d * * * * * * * C)', e.event_id, e.event_id % 100, e.event_id % 100 + 7))), '\n'), '\n)')"""


def _twf_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type").groupBy("user_id", F.call_function("div", "event_id", F.lit(5000)).alias("part")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("es"))
    e = e.select("user_id", F.expr(TWF_BODY).alias("body"))
    clocks = "".join(f'(WAVEFORM "clk{k}" {k + 1}.0 (POSEDGE 0.0) (NEGEDGE 0.5))\n' for k in range(4))
    return _files(e, "user_id", "body", "user_id", f'(TIMING_WINDOWS\n(HEADER (DELIMITERS "/[]") (TIME_SCALE 1e-9))\n{clocks}', "\n)\n", 20)


def _twf(spark: SparkSession, d: str) -> DataFrame:
    return X.parse(X.split_texts(_twf_files(spark, d), "twf", 20_000), "twf")


@R("sc18_timing_entries", "select 'e' || event_id as name, case when user_id % 5 < 4 then 'clk' || user_id % 5 end as clock, cast(event_id % 100 as double) as lo, cast(event_id % 100 + 7 as double) as hi from events where event_type <> 'error'")
@R("sc19_chunked_timing", "select 'e' || event_id as name, case when user_id % 5 < 4 then 'clk' || user_id % 5 end as clock, cast(event_id % 100 as double) as lo, cast(event_id % 100 + 7 as double) as hi from events where event_type <> 'error'")
def _(spark, d):
    return X.entries(_twf(spark, d)).select("name", "clock", F.col("rise_arrival_min").alias("lo"), F.col("rise_arrival_max").alias("hi"))


@R("sc18_bad_records", "select 'bad' as kind, count(*) as n from events where event_type = 'error'")
def _(spark, d):
    return _twf(spark, d).where("kind = 'bad'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# streams


@R("sm01_cursor_batches", "select worker_id, count(*) as n, max(epoch_ms) as last_ms from (select distinct worker_id, epoch_ms from worker_samples) group by worker_id")
def _(spark, d):
    s = table(spark, d, "worker_samples", "worker_id", "epoch_ms", "kind").distinct()
    cursor = N.Cursors("worker_id", "epoch_ms")
    mid = s.groupBy("worker_id").agg(F.percentile_approx("epoch_ms", 0.5).alias("m"))
    early = cursor.take(s.join(mid, "worker_id").where("epoch_ms <= m").drop("m", "kind"))
    late = cursor.take(s.drop("kind"))
    return early.unionByName(late).groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch_ms").alias("last_ms"))


@R("sm03_stream_append", "select distinct worker_id, epoch_ms from worker_samples")
def _(spark, d):
    return N.drained(N.append_once(N.stream(spark, d, "worker_samples").select("worker_id", "epoch_ms"), ["worker_id", "epoch_ms"]))


UPSERT = "select task_id, max(created_ms) as created_ms from tasks group by task_id"


@R("sm02_merge_by_key", UPSERT)
def _(spark, d):
    s = N.stream(spark, d, "tasks", max_files=4).select("task_id", "created_ms")
    up = N.Upserts(spark, s.schema, ["task_id"], ["created_ms"])
    N.drain(s, up)
    return up.table()


@R("sc23_metrics_source", "select status, count(*) as n from tasks group by status")
def _(spark, d):
    return table(spark, d, "tasks", "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R("sm08_decayed_stream")
def _(spark, d):
    s = N.stream(spark, d, "object_io").select("object_name", F.floor(F.col("epoch_ms") / 1000).alias("t"), "bytes")
    keep = N.Upserts(spark, "object_name string, last_s bigint, score double", ["object_name"], ["last_s", "score"])
    N.drain(N.decayed_stream(s, "object_name", "t", "bytes", 0.0005), keep, "update")
    return keep.table()


@R("wn08_throttled")
def _(spark, d):
    return N.throttled(table(spark, d, "worker_samples", "worker_id", "epoch_ms"), "worker_id", "epoch_ms", 200)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return N.stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R("sm_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    return _ntz(N.drained(N.tumbling(_events(spark, d), "ts", "1 hour", ["event_type"]), "complete")).withColumn("total", F.round("total", 4))


@R("sm_sliding", "select unnest([b, b - interval 30 minute]) as start, count(*) as n, round(sum(value), 4) as total from (select time_bucket(interval 30 minute, ts) b, value from events) group by 1")
def _(spark, d):
    return _ntz(N.drained(N.tumbling(_events(spark, d), "ts", "1 hour", [], slide="30 minutes"), "complete")).withColumn("total", F.round("total", 4))


@R("sm_sessions", "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts) k from x) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def _(spark, d):
    return _ntz(N.drained(N.sessions(_events(spark, d), "ts", "2 hours", ["user_id"]), "complete")).select("user_id", "start", "n")


# flows

_flows = Flows()


@_flows.flow("open_orders", ("orders",))
def _open_orders(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderstatus = 'O'")


@_flows.flow("by_customer", ("open_orders",))
def _by_customer(orders: DataFrame) -> DataFrame:
    return chained(orders, lambda x: x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), lambda x: x.where("n > 1"))


@R("ud01_flow", "select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1 having count(*) > 1")
def _(spark, d):
    return _flows.run("by_customer", {"orders": table(spark, d, "orders", "o_custkey", "o_orderstatus")})


# solver: systems of its own, on grids of a fixed size

GRID_N = 20
POISSON = f"g as (select i, i // {GRID_N} r, i % {GRID_N} c from range({GRID_N * GRID_N}) t(i)), a as (select x.i, y.i as j, case when x.i = y.i then 4.0::double else -1.0::double end as v from g x join g y on abs(x.r - y.r) + abs(x.c - y.c) <= 1)"


@R("sv01_poisson", f"with {POISSON} select i, j, v from a")
def _(spark, d):
    return V.poisson(spark, GRID_N)


@R("sv02_blocks", f"with {POISSON} select i, cast(case when r < 10 then 0 else 3 end + case when c < 7 then 0 when c < 14 then 1 else 2 end as integer) as sd from g")
def _(spark, d):
    return V.grid_blocks(spark, GRID_N, 6)


@R("sv03_row_blocks", f"select i, cast(k as integer) as sd from range({GRID_N * GRID_N}) t(i), range(4) u(k) where i >= k * 100 - 40 and i < k * 100 + 140")
def _(spark, d):
    b = V.bounds(GRID_N * GRID_N, 4)
    parts = F.array(*(F.struct(F.lit(k).alias("sd"), F.lit(b[k] - 40).alias("lo"), F.lit(b[k + 1] + 40).alias("hi")) for k in range(4)))
    x = spark.range(GRID_N * GRID_N).select(F.col("id").alias("i"), F.explode(parts).alias("p"))
    return x.where("i >= p.lo and i < p.hi").select("i", "p.sd")


@R("sv04_hops", f"with {POISSON} select y.i as id, cast(min(abs(x.r - y.r) + abs(x.c - y.c)) as integer) as hops from g x, g y where x.r < 10 and x.c < 10 and abs(x.r - y.r) + abs(x.c - y.c) <= 3 group by y.i")
def _(spark, d):
    e = V.poisson(spark, GRID_N).select(F.col("i").alias("a"), F.col("j").alias("b"))
    start = V.grid_blocks(spark, GRID_N, 4).where("sd = 0").select(F.col("i").alias("id"))
    return H.within_hops(e, start, 3)


@R("sv05_widened_blocks", f"with {POISSON}, o as (select i, r, c, case when r < 10 then 0 else 2 end + case when c < 10 then 0 else 1 end sd from g) select distinct o.sd, g.i, g.i in (select i from o p where p.sd = o.sd) as own from o join g on abs(o.r - g.r) + abs(o.c - g.c) <= 2")
def _(spark, d):
    return V.widened(V.poisson(spark, GRID_N), V.grid_blocks(spark, GRID_N, 4), 2)


@R("sv05_submatrix_ghosts", f"with {POISSON}, o as (select i, r, c, case when r < 10 then 0 else 2 end + case when c < 10 then 0 else 1 end sd from g), w as (select distinct o.sd, g.i from o join g on abs(o.r - g.r) + abs(o.c - g.c) <= 2), x as (select w.sd, a.i, a.j, a.v, exists (select 1 from w q where q.sd = w.sd and q.i = a.j) as inside from a join w on a.i = w.i) select sd, case when inside then 'matrix' else 'ghost' end as part, count(*) as n, sum(v) as total, count(distinct j) as n_ids from x group by all")
def _(spark, d):
    s = V.sub_systems(V.poisson(spark, GRID_N), V.grid_blocks(spark, GRID_N, 4), 2)
    return s.groupBy("sd", F.when(F.col("inside"), "matrix").otherwise("ghost").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.count_distinct("j").alias("n_ids"))


@R("jn26_triple_product", f"with {POISSON}, m as (select i, (r + 1) * 6.0 / 21 - 1 fr, (c + 1) * 6.0 / 21 - 1 fc from g), k as (select i, floor(fr) + a r, floor(fc) + b c, (case a when 1 then fr - floor(fr) else 1 - (fr - floor(fr)) end) * (case b when 1 then fc - floor(fc) else 1 - (fc - floor(fc)) end) v from m, range(2) x(a), range(2) y(b)), p as (select i, cast(r * 5 + c as bigint) j, v from k where v > 0 and r >= 0 and r < 5 and c >= 0 and c < 5) select p.j as i, q.j, round(cast(sum(p.v * a.v * q.v) as double), 6) as v from p join a on p.i = a.i join p q on a.j = q.i group by p.j, q.j having abs(sum(p.v * a.v * q.v)) > 1e-9")
def _(spark, d):
    p = V.bilinear(spark, GRID_N, 5)
    return V.product(V.product(V.transposed(p), V.poisson(spark, GRID_N)), p).where("abs(v) > 1e-9").withColumn("v", F.round("v", 6))


@R("fn21_bilinear", f"with {POISSON}, m as (select i, (r + 1) * 6.0 / 21 - 1 fr, (c + 1) * 6.0 / 21 - 1 fc from g), k as (select i, floor(fr) + a r, floor(fc) + b c, (case a when 1 then fr - floor(fr) else 1 - (fr - floor(fr)) end) * (case b when 1 then fc - floor(fc) else 1 - (fc - floor(fc)) end) v from m, range(2) x(a), range(2) y(b)) select i, cast(r * 5 + c as bigint) as j, round(cast(v as double), 6) as v from k where v > 1e-9 and r >= 0 and r < 5 and c >= 0 and c < 5")
def _(spark, d):
    return V.bilinear(spark, GRID_N, 5).where("v > 1e-9").withColumn("v", F.round("v", 6))


@R("ag56_residual", f"with {POISSON}, x as (select i, (i % 7) * 0.5 v from g), ax as (select a.i, sum(a.v * x.v) s from a join x on a.j = x.i group by a.i) select round(sqrt(sum(pow(1 - s, 2))), 6) as residual, round(sqrt(sum(pow(1 - s, 2))) / sqrt(count(*)), 6) as relative, round(max(abs(1 - s)), 6) as largest from ax")
def _(spark, d):
    x = spark.range(GRID_N * GRID_N).select(F.col("id").alias("i"), ((F.col("id") % 7) * 0.5).alias("v"))
    ax = V.multiply(V.poisson(spark, GRID_N), x).select((1 - F.col("v")).alias("r"))
    return ax.agg(F.round(F.sqrt(F.sum(F.col("r") * F.col("r"))), 6).alias("residual"), F.round(F.sqrt(F.sum(F.col("r") * F.col("r"))) / F.sqrt(F.count(F.lit(1))), 6).alias("relative"), F.round(F.max(F.abs("r")), 6).alias("largest"))


def solution(n: int) -> str:
    """SQL of the solution u (i, v) of an n by n grid with ones on the right, by sine transforms along both axes."""
    return f"""k as (select p, 2 - 2 * cos(p * pi() / {n + 1}) as l from range(1, {n + 1}) t(p)), s as (select p, r, sqrt(2.0::double / {n + 1}) * sin(p * pi() * (r + 1) / {n + 1}) as v from range(1, {n + 1}) t(p), range({n}) t2(r)),
f as (select s.p, any_value(l) as l, sum(v) as w from s join k on s.p = k.p group by s.p), h as (select x.p, s.r as c, sum(s.v * x.w * y.w / (x.l + y.l)) as v from s join f y on s.p = y.p, f x group by x.p, s.r),
u as (select s.r * {n} + h.c as i, sum(s.v * h.v) as v from s join h on s.p = h.p group by 1)"""


def _system(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    return V.poisson(spark, n), spark.range(n * n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


def _schwarz(spark: SparkSession, n: int, blocks: int, hops: int, coarse: int, tol: float) -> tuple[DataFrame, int, float]:
    a, b = _system(spark, n)
    return V.Schwarz(a, V.grid_blocks(spark, n, blocks), hops, V.bilinear(spark, n, coarse)).solve(b, tol)


@R("sv07_schwarz", f"with {solution(50)} select i, round(v, 3) as v, true as converged from u")
def _(spark, d):
    x, _, rel = _schwarz(spark, 50, 4, 3, 25, 1e-9)
    return x.select("i", F.round("v", 3).alias("v"), F.lit(rel <= 1e-9).alias("converged"))


TOTALS = "select count(*) as n, round(max(v), 2) as largest, round(sum(v) / 1e6, 3) as total from u"


def _totals(x: DataFrame) -> DataFrame:
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 2).alias("largest"), F.round(F.sum("v") / 1e6, 3).alias("total"))


@R("sv07_schwarz_200", f"with {solution(200)} {TOTALS}")
def _(spark, d):
    return _totals(_schwarz(spark, 200, 16, 8, 15, 1e-9)[0])


@R("sv07_schwarz_500", f"with {solution(500)} {TOTALS}")
def _(spark, d):
    return _totals(_schwarz(spark, 500, 16, 16, 31, 1e-9)[0])


@R("st_window_first", "select user_id, min(event_id) as first_event from events group by user_id")
def _(spark, d):
    return O.latest(table(spark, d, "events", "user_id", "event_id"), ["user_id"], ["event_id"], first=True).select("user_id", F.col("event_id").alias("first_event"))


# the rest of the catalogue, the formats, the increments and the solver


@R("sc03_temp_dataset", "select c_nationkey, count(*) as n from customer group by c_nationkey")
def _(spark, d):
    db = _catalog(spark).create("work")
    db.write_temp("counts", table(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))
    return db.read("counts")


@R("sc04_remove", "select 'nation' as name")
def _(spark, d):
    db = _catalog(spark).create("gone")
    db.write("nation", table(spark, d, "nation"))
    db.write("region", table(spark, d, "region"))
    db.remove("region")
    db.remove("region", missing_ok=True)
    return spark.createDataFrame([(n,) for n in db.names()], "name string")


@R("sc08_codecs", "select codec, count(*) as n, cast(sum(o_custkey) as bigint) as total from orders, (select unnest(['gzip', 'lz4_raw', 'none', 'zstd']) codec) group by codec")
def _(spark, d):
    db = _catalog(spark).create("packed")
    o = table(spark, d, "orders", "o_custkey")
    out = None
    for codec in ("gzip", "lz4_raw", "none", "zstd"):
        db.write(codec, o, codec=codec)
        x = db.read(codec).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total")).select(F.lit(codec).alias("codec"), "n", "total")
        out = x if out is None else out.unionByName(x)
    return out


@R("sc09_replayed_log", """with t as (select task_id, bool_or(status = 'COMPLETED') ok from tasks group by 1), l as (select o.object_name, o.epoch_ms, o.id, direction = 'w' as added from object_io o join t on o.task_id = t.task_id where ok)
select object_name, max(epoch_ms) as at_ms from (select *, last_value(added) over (partition by object_name order by epoch_ms, id, added rows between unbounded preceding and unbounded following) keep from l) where keep group by object_name""")
def _(spark, d):
    t = table(spark, d, "tasks", "task_id", "status").groupBy("task_id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("ok"))
    log = table(spark, d, "object_io", "object_name", "epoch_ms", "id", "direction", "task_id").join(t, "task_id").select("object_name", "epoch_ms", "id", (F.col("direction") == "w").alias("added"), F.col("task_id").alias("txn"), "ok")
    return N.replayed(log, "object_name", ["epoch_ms", "id"], "added", "ok").select("object_name", F.col("epoch_ms").alias("at_ms"))


@R("sc20_sniffers", "select * from (values ('lef', true, false, false, false), ('def', true, true, false, false), ('liberty', false, false, true, false), ('twf', false, false, false, true)) t(file, lef, def, liberty, twf)")
def _(spark, d):
    f = spark.createDataFrame([("lef", "# x\nLAYER M1 "), ("def", "VERSION 5.8 ;\nDESIGN a ;"), ("liberty", "/* a */ library (x) {"), ("twf", "\n(TIMING_WINDOWS")], "file string, text string")
    plain = F.regexp_replace("text", r"#[^\n]*|(?s)/\*.*?\*/", " ")
    return f.select("file", *(F.regexp_like(plain, F.lit("^" + X.HEADERS[k])).alias(k) for k in ("lef", "def", "liberty", "twf")))


@R("sm07_replay", "select count(*) as n from object_io")
def _(spark, d):
    out, progress = N.folder_of(spark, "replayed"), N.folder_of(spark, "progress")
    s = N.stream(spark, d, "object_io").select("id")
    for _ in range(2):  # the second run finds nothing new
        N.drain(s, lambda b, n: b.write.mode("append").parquet(out), checkpoint=progress)
    return spark.read.schema("id bigint").parquet(out).agg(F.count(F.lit(1)).alias("n"))


VALUES = "select i, round(v, 6) as v from u"


@R("sv06_local_solves", f"with {solution(10)} {VALUES}")
def _(spark, d):
    # one block over all: its local solution is the global one
    a, b = _system(spark, 10)
    s = V.Schwarz(a, spark.range(100).select(F.col("id").alias("i"), F.lit(0).alias("sd")), 0)
    return s.step(b.withColumn("v", F.lit(0.0)), b).withColumn("v", F.round("v", 6))


@R("sv06_overlapping_solves", f"with {solution(10)} {VALUES}")
def _(spark, d):
    # four overlapping blocks are told the solution just outside them and nothing else; their owners' values are the solution
    a, b = _system(spark, 10)
    s = V.Schwarz(a, V.grid_blocks(spark, 10, 4), 1)
    x = spark.createDataFrame(list(enumerate(map(float, V.exact(a, b, 100)))), "i bigint, v double")
    told = x.join(s.ghosts.select("i").distinct().withColumn("g", F.lit(True)), "i", "left").select("i", F.when(F.col("g"), F.col("v")).otherwise(1e6).alias("v"))
    return s.step(told, b).withColumn("v", F.round("v", 6))


@R("sv08_coarse_correction", """with recursive c as (select i, (i // 10 + 1) * 2.0 / 11 - 1 as fr, (i % 10 + 1) * 2.0 / 11 - 1 as fc from range(100) t(i)), p as (select i, (1 - abs(fr)) * (1 - abs(fc)) as v from c),
ap as (select x.i, sum(case when x.i = y.i then 4.0 else -1.0 end * y.v) as v from p x join p y on abs(x.i // 10 - y.i // 10) + abs(x.i % 10 - y.i % 10) <= 1 group by x.i), e as (select (select sum(v) from p) / (select sum(p.v * ap.v) from p join ap on p.i = ap.i) as v)
select p.i, round(cast(p.v * e.v as double), 6) as v from p, e""")
def _(spark, d):
    # a coarse level of one unknown, whose answer SQL can work out: from zero, ones on the right are the residual
    a, b = _system(spark, 10)
    s = V.Schwarz(a, V.grid_blocks(spark, 10, 4), 1, V.bilinear(spark, 10, 1))
    return s.corrected(b.withColumn("v", F.lit(0.0)), b).withColumn("v", F.round("v", 6))


@R("sv09_time_steps", f"with {solution(8)} select t, i, round(v * (1 + t / 1000), 5) as v from u, range(3) x(t)")
def _(spark, d):
    a, b = _system(spark, 8)
    runs = V.Schwarz(a, V.grid_blocks(spark, 8, 2), 2).march(b, lambda x, t: b.withColumn("v", F.lit(1 + t / 1000)) if t < 3 else None, tol=1e-9)
    out = None
    for t, (x, _, _) in enumerate(runs):
        x = x.select(F.lit(t).cast("bigint").alias("t"), "i", F.round("v", 5).alias("v"))
        out = x if out is None else out.unionByName(x)
    return out


@R("ud05_right_hand_sides", f"with {solution(6)}, g as (select i, i // 6 r, i % 6 c from range(36) t(i)), b1 as (select i, v from u), hh as (select s.p, q.p as q, sum(s.v * q.v * b1.v) / any_value(ks.l + kq.l) as w from b1 join g on b1.i = g.i join s on s.r = g.r join s q on q.r = g.c join k ks on ks.p = s.p join k kq on kq.p = q.p group by s.p, q.p) select 0::bigint as t, i, round(v, 5) as v from u union all select 1, g.i, round(sum(hh.w * s.v * q.v), 5) from g join s on s.r = g.r join s q on q.r = g.c join hh on hh.p = s.p and hh.q = q.p group by g.i")
def _(spark, d):
    # the right-hand side of the second time is the solution of the first
    a, b = _system(spark, 6)
    (x, _, _), (y, _, _) = V.Schwarz(a, V.grid_blocks(spark, 6, 2), 2).march(b, lambda x, t: x if t == 1 else None, tol=1e-9)
    part = lambda t, z: z.select(F.lit(t).cast("bigint").alias("t"), "i", F.round("v", 5).alias("v"))
    return part(0, x).unionByName(part(1, y))


@R("sm11_warm_start", f"with {solution(8)} select 'warm' as start, true as fewer_steps, round(sum(v) * 1.001, 4) as total from u")
def _(spark, d):
    # a right-hand side that has hardly changed takes fewer steps from the last solution than from zero
    a, b = _system(spark, 8)
    s = V.Schwarz(a, V.grid_blocks(spark, 8, 2), 2)
    (_, cold, _), (x, warm, _) = s.march(b, lambda x, t: b.withColumn("v", F.lit(1.001)) if t == 1 else None, tol=1e-7)
    return x.agg(F.round(F.sum("v"), 4).alias("total")).select(F.lit("warm").alias("start"), F.lit(warm < cold).alias("fewer_steps"), "total")


@R("sv10_exact", f"with {solution(10)} {VALUES}")
def _(spark, d):
    a, b = _system(spark, 10)
    return spark.createDataFrame(list(enumerate(map(float, V.exact(a, b, 100)))), "i bigint, v double").withColumn("v", F.round("v", 6))


@R("sm12_last_bucket", "with s as (select distinct worker_id k, epoch_ms // 3600000 b from worker_samples), z as (select max(b) z from s), f as (select k, min(b) a from s group by k) select z as bucket, count(*) as n_workers from f, z where a <= z group by z")
def _(spark, d):
    g = O.carried(table(spark, d, "worker_samples", "worker_id", "epoch_ms"), "worker_id", "epoch_ms", [], 3_600_000)
    return g.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_workers")).orderBy(F.desc("bucket")).limit(1)


@R("ud07_by_role", "select 'timing' as role, count(*) as n from nation")
def _(spark, d):
    c = _catalog(spark)
    a = c.create("lib", role="timing")
    a.write("nation", table(spark, d, "nation"))
    b = c.create("top", role="design").after(a)
    return c.find(b, role="timing")[0].read("nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("timing").alias("role"), "n")


@R("ud08_checked_parameters", "select r_regionkey from region where r_regionkey < 3")
def _(spark, d):
    flows = Flows()
    flows.flow("first", ("region",), C.dict_of({"n": C.of(int, test=lambda v: v > 0, needs="above 0")}))(lambda r, n: r.where(F.col("r_regionkey") < n))
    return flows.run("first", {"region": table(spark, d, "region", "r_regionkey")}, n=3)
