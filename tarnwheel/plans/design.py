"""Hierarchy, geometry and graph queries, on a design laid out from the star tables.

A chip holds regions (odd ones twice), regions hold nations, nations hold customers; nets are market segments; orders
are rectangles. DESIGN says so in SQL that DuckDB reads; the functions below say it in DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import ordered as O
from ..operators import spatial as G
from ..session import broadcast_if_small, cut, one_row, table
from ..sources.catalog import stored
from .base import Register

R = Register()
QUERIES, SQL = R.queries, R.sql

INST = """ci as (select 'chip' block, 'r' || r_regionkey || '_' || c as name, 'region_' || r_regionkey child, cast(r_regionkey as bigint) k, cast(c as bigint) c, cast(r_regionkey * 4000 + c * 2000 as bigint) dx, cast(c * 100 as bigint) dy, cast((r_regionkey + c) % 8 as integer) orient
 from region, (select unnest([0, 1]) c) where c <= r_regionkey % 2),
ri as (select 'region_' || n_regionkey block, 'n' || n_nationkey as name, 'nation_' || n_nationkey child, cast(n_nationkey as bigint) k, cast(0 as bigint) c, cast((n_nationkey % 5) * 300 as bigint) dx, cast(n_nationkey // 5 * 200 as bigint) dy, cast(n_nationkey % 8 as integer) orient from nation),
ni as (select 'nation_' || c_nationkey block, 'c' || c_custkey as name, cast(null as varchar) child, c_custkey k, cast(0 as bigint) c, c_custkey % 250 dx, c_custkey * 7 % 180 dy, cast(c_custkey % 8 as integer) orient from customer),
ai as (select * from ci union all select * from ri union all select * from ni),
inst as (select block, row_number() over (partition by block order by k, c) as local_id, name, child, dx, dy, orient, k from ai)"""
NETS = """nets as (select block, row_number() over (partition by block order by seg) as local_id, seg as name from (select distinct b.block, c_mktsegment seg from (select distinct block from inst) b, customer where block <> 'chip' or c_mktsegment < 'H'))"""
BLOCKS = """blocks as (select i.block, i.n n_instances, coalesce(m.n, 0) n_nets, i.n % 3 as n_vias from (select block, count(*) n from inst group by 1) i left join (select block, count(*) n from nets group by 1) m on i.block = m.block)"""


def _turn(x: str, y: str, o: str) -> tuple[str, str]:
    """SQL of (x, y) under orientation o."""
    k, m = f"case when {o} < 4 then {o} else (8 - {o}) % 4 end", f"case when {o} >= 4 then -({x}) else ({x}) end"
    return f"case {k} when 0 then {m} when 1 then -({y}) when 2 then -({m}) else ({y}) end", f"case {k} when 0 then ({y}) when 1 then {m} when 2 then -({y}) else -({m}) end"


_tx, _ty = _turn("i.dx", "i.dy", "t.orient")
_ka, _kb = ("case when {0} < 4 then {0} else (8 - {0}) % 4 end".format(x) for x in ("t.orient", "i.orient"))
_kk = f"(((case when t.orient >= 4 then {_ka} - {_kb} else {_ka} + {_kb} end) % 4 + 4) % 4)"
_oo = f"case when (t.orient >= 4) <> (i.orient >= 4) then 4 + (4 - {_kk}) % 4 else {_kk} end"
TREE = f"""walk as (select 'chip' block, '' as name, '' path, cast([] as bigint[]) as key, cast(0 as bigint) local_id, cast(0 as bigint) dx, cast(0 as bigint) dy, cast(0 as integer) orient
 union all select i.child, i.name, case when t.path = '' then i.name else t.path || '/' || i.name end, list_append(t.key, i.local_id), i.local_id, {_tx} + t.dx, {_ty} + t.dy, cast({_oo} as integer) from walk t join inst i on i.block = t.block where i.child is not null),
num as (select row_number() over (order by key) - 1 as node_id, len(key) depth, w.*, n_instances + 1 inst_count, n_nets + 1 net_count, n_vias via_count from walk w join blocks b on w.block = b.block),
tree as (select a.node_id, coalesce(p.node_id, a.node_id) parent_id, cast(a.depth as integer) depth, a.block, a.name, a.path, a.local_id, a.dx, a.dy, a.orient,
 cast(coalesce(sum(a.inst_count) over w, 0) as bigint) inst_start, a.inst_count, cast(coalesce(sum(a.net_count) over w, 0) as bigint) net_start, a.net_count, cast(coalesce(sum(a.via_count) over w, 0) as bigint) via_start, a.via_count
 from num a left join num p on p.key = a.key[:-2] and len(a.key) > 0 window w as (order by a.node_id rows between unbounded preceding and 1 preceding))"""
DESIGN = f"with recursive {INST}, {NETS}, {BLOCKS}, {TREE} "


def instances(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    cols = ["block", "name", "child", "k", "c", "dx", "dy", "orient"]
    c = region.select("r_regionkey", F.explode(F.expr("sequence(0, r_regionkey % 2)")).alias("c")).selectExpr(
        "'chip' block", "concat('r', r_regionkey, '_', c) name", "concat('region_', r_regionkey) child", "cast(r_regionkey as bigint) k", "cast(c as bigint) c", "cast(r_regionkey * 4000 + c * 2000 as bigint) dx", "cast(c * 100 as bigint) dy", "cast((r_regionkey + c) % 8 as int) orient"
    )
    r = nation.selectExpr("concat('region_', n_regionkey) block", "concat('n', n_nationkey) name", "concat('nation_', n_nationkey) child", "cast(n_nationkey as bigint) k", "0L c", "cast((n_nationkey % 5) * 300 as bigint) dx", "cast(n_nationkey div 5 * 200 as bigint) dy", "cast(n_nationkey % 8 as int) orient")
    n = customer.selectExpr("concat('nation_', c_nationkey) block", "concat('c', c_custkey) name", "cast(null as string) child", "c_custkey k", "0L c", "c_custkey % 250 dx", "c_custkey * 7 % 180 dy", "cast(c_custkey % 8 as int) orient")
    a = c.select(*cols).unionByName(r.select(*cols)).unionByName(n.select(*cols))
    w = ordered_by("block", "k", "c")
    return a.withColumn("local_id", F.row_number().over(w).cast("bigint"))


def ordered_by(part: str, *order: str) -> Window:
    return Window.partitionBy(part).orderBy(*order)


def nets(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "customer", "c_mktsegment").distinct()
    b = instances(spark, d).select("block").distinct()
    segs = seg.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))  # a handful of segment names
    x = b.crossJoin(one_row(segs)).select("block", F.explode("s").alias("c_mktsegment")).where("block <> 'chip' or c_mktsegment < 'H'")
    return x.select("block", F.row_number().over(ordered_by("block", "c_mktsegment")).cast("bigint").alias("local_id"), F.col("c_mktsegment").alias("name"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of a folder's tables, built once."""
    return stored(spark, "tree", [f"{d}/{t}.parquet" for t in ("region", "nation", "customer")], lambda: built_tree(spark, d))


def built_tree(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d)
    b = i.groupBy("block").agg(F.count(F.lit(1)).alias("n_instances")).join(nets(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block", "left")
    b = b.select("block", "n_instances", F.coalesce("n", F.lit(0)).alias("n_nets"), (F.col("n_instances") % 3).alias("n_vias"))
    return H.build_tree(b, i)


@R("gh01_tree", DESIGN + "select node_id, parent_id, depth, block, name, path from tree")
def _(spark, d):
    return built_tree(spark, d).select("node_id", "parent_id", "depth", "block", "name", "path")


@R("gh02_transforms", DESIGN + "select node_id, dx, dy, orient from tree")
def _(spark, d):
    return tree(spark, d).select("node_id", "dx", "dy", "orient")


@R("wn04_id_ranges", DESIGN + "select node_id, inst_start, inst_count, net_start, net_count, via_start, via_count from tree")
def _(spark, d):
    return tree(spark, d).select("node_id", *(f"{k}_{x}" for k in ("inst", "net", "via") for x in ("start", "count")))


@R("gh04_references", DESIGN + "select distinct block, child from inst where child is not null")
def _(spark, d):
    return instances(spark, d).where("child is not null").select("block", "child").distinct()


@R("gh05_tree_lines", DESIGN + "select node_id, repeat('  ', depth) || case when depth = 0 then block else name end as line from tree")
def _(spark, d):
    return H.children_order(tree(spark, d))


_cx, _cy = _turn("i.dx", "i.dy", "t.orient")
FLAT = DESIGN + f", flat as (select t.node_id, t.inst_start + i.local_id as gid, i.name, case when t.path = '' then i.name else t.path || '/' || i.name end as path, i.k, i.child, {_cx} + t.dx as x, {_cy} + t.dy as y from tree t join inst i on t.block = i.block)"


def flat(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """Every instance at every position: node, global id, path and place."""
    t = t or tree(spark, d)
    i = instances(spark, d).select("block", "local_id", F.col("name").alias("iname"), "child", F.col("dx").alias("ix"), F.col("dy").alias("iy"), "k")
    f = H.to_global(t, i, "inst", "local_id", "gid", ("path", "dx", "dy", "orient"))
    x, y = G.place_point(F.col("ix"), F.col("iy"), F.col("dx"), F.col("dy"), F.col("orient"))
    path = F.concat("path", F.when(F.col("path") == "", "").otherwise("/"), "iname")
    return f.select("node_id", "gid", F.col("iname").alias("name"), path.alias("path"), "k", "child", x.alias("x"), y.alias("y"))


@R("jn11_global_ids", FLAT + "select node_id, gid, name from flat")
@R("jn21_every_instantiation", FLAT + "select node_id, gid, name from flat")
def _(spark, d):
    return flat(spark, d).select("node_id", "gid", "name")


@R("gh03_flatten", FLAT + "select gid, path, x, y from flat where child is null")
def _(spark, d):
    return flat(spark, d).where("child is null").select("gid", "path", "x", "y")


@R("jn12_owner_of_id", FLAT + "select f.gid, t.node_id, t.block, f.gid - t.inst_start as local_id from flat f left join tree t on f.gid >= t.inst_start and f.gid < t.inst_start + t.inst_count")
def _(spark, d):
    t = tree(spark, d)
    ids = flat(spark, d, t).select("gid")
    return H.owner_of(ids, "gid", t, "inst_start", "inst_count", ["node_id", "block", "inst_start"]).select("gid", "node_id", "block", (F.col("gid") - F.col("inst_start")).alias("local_id"))


@R("jn20_path_to_id", FLAT + "select f.path, f.gid, t.block from flat f join tree t on f.node_id = t.node_id")
@R("pq05_convert_path", FLAT + "select f.path, f.gid, t.block from flat f join tree t on f.node_id = t.node_id")
def _(spark, d):
    # a path splits into its node's path and a leaf name; both are looked up
    nodes = tree(spark, d)
    f = flat(spark, d, nodes)
    t, _ = broadcast_if_small(nodes.select(F.col("path").alias("node_path"), "block", "inst_start"), 500_000, written=True)
    leaf = instances(spark, d).select("block", F.col("name").alias("leaf"), "local_id")
    p = f.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("node_path"), F.substring_index("path", "/", -1).alias("leaf"))
    return p.join(t, "node_path").join(leaf, ["block", "leaf"]).select("path", (F.col("inst_start") + F.col("local_id")).alias("gid"), "block")


@R("wn05_dense_ids", "select n_name as name, row_number() over (order by n_nationkey) as id from (select n_name, min(n_nationkey) n_nationkey from nation group by 1)")
def _(spark, d):
    n = table(spark, d, "nation", "n_name", "n_nationkey").groupBy("n_name").agg(F.min("n_nationkey").alias("k"))
    return O.dense_ids(n, ["k"], "id", start=1).select(F.col("n_name").alias("name"), "id")


@R("wn05_dense_pins", "select name, row_number() over (order by a, name) - 1 as id from (select name, min(created_ms) a from tasks group by 1)")
def _(spark, d):
    n = table(spark, d, "tasks", "name", "created_ms").groupBy("name").agg(F.min("created_ms").alias("a"))
    return O.dense_ids(n, ["a", "name"], "id").select("name", "id")


# docking and components

DOCK = DESIGN + """, pn as (select t.node_id, t.parent_id, t.depth, n.name, t.net_start + n.local_id gid from tree t join nets n on t.block = n.block),
edges as (select distinct least(a.gid, b.gid) a, greatest(a.gid, b.gid) b from pn a join pn b on a.node_id = b.parent_id and a.name = b.name and b.depth > 0 where a.gid <> b.gid)"""


def placed_nets(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    return H.to_global(t, nets(spark, d), "net", "local_id", "gid").join(t.select("node_id", "parent_id", "depth"), "node_id").select("node_id", "parent_id", "depth", "name", "gid")


def docking(p: DataFrame) -> DataFrame:
    """Edges between nets of a name in a node and in its parent."""
    up = p.select(F.col("node_id").alias("parent_id"), "name", F.col("gid").alias("pg"))
    j = p.where("depth > 0").join(up, ["parent_id", "name"])
    return j.select(F.least("gid", "pg").alias("a"), F.greatest("gid", "pg").alias("b")).where("a <> b").distinct()


@R("jn10_docking", DOCK + "select a, b from edges")
def _(spark, d):
    return docking(cut(placed_nets(spark, d)))


@R("ag44_components", DOCK + """, reach as (select gid id, gid r from pn union select x.id, e.y from reach x join (select a x, b y from edges union all select b, a from edges) e on x.r = e.x),
dep as (select gid id, depth from pn), best as (select x.id, arg_min(x.r, struct_pack(d := dep.depth, r := x.r)) root, count(*) as size from reach x join dep on x.r = dep.id group by x.id) select id, root, size from best""")
def _(spark, d):
    p = cut(placed_nets(spark, d))
    e = docking(p).unionByName(p.select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    return H.rerooted(H.components(e), p.select(F.col("gid").alias("id"), "depth"))


@R("ag45_global_kinds", DOCK + "select distinct name as kind, gid from pn where name in ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return placed_nets(spark, d).where(F.col("name").isin("BUILDING", "MACHINERY")).select(F.col("name").alias("kind"), "gid").distinct()


@R("jn22_nearest_ancestor", DESIGN + ", up as (select node_id s, parent_id id, 1 h from tree where depth > 0 union all select s, t.parent_id, h + 1 from up join tree t on up.id = t.node_id where t.depth > 0), hit as (select s, id, h, row_number() over (partition by s order by h) n from up join tree t on up.id = t.node_id where t.block like 'region%' or t.block = 'chip') select s as start, id, cast(h as integer) as hops from hit where n = 1")
@R("pq07_find_db", DESIGN + ", up as (select node_id s, parent_id id, 1 h from tree where depth > 0 union all select s, t.parent_id, h + 1 from up join tree t on up.id = t.node_id where t.depth > 0), hit as (select s, id, h, row_number() over (partition by s order by h) n from up join tree t on up.id = t.node_id where t.block like 'region%' or t.block = 'chip') select s as start, id, cast(h as integer) as hops from hit where n = 1")
def _(spark, d):
    t = tree(spark, d)
    e = t.where("depth > 0").select(F.col("node_id").alias("a"), F.col("parent_id").alias("b"), F.lit(0).alias("ord"))
    return H.nearest_match(e, t.where("depth > 0").select(F.col("node_id").alias("id")), t.where("block like 'region%' or block = 'chip'").select(F.col("node_id").alias("id")))


# rectangles: orders on a 10000 x 8000 die

RECT = "o_orderkey as id, cast(o_orderkey * 7919 % 10000 as bigint) as xl, cast(o_custkey * 104729 % 8000 as bigint) as yl, cast(o_orderkey * 7919 % 10000 + 1 + o_orderkey % 40 as bigint) as xh, cast(o_custkey * 104729 % 8000 + 1 + o_custkey % 30 as bigint) as yh, cast(o_orderkey % 3 + 1 as integer) as layer, cast(o_orderkey % 8 as integer) as orient"
RECTS = f"with r as (select {RECT} from orders) "
BIN = (0, 0), (100, 100), (100, 80)
XY = ("xl", "yl", "xh", "yh")


def rects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_custkey").selectExpr(*RECT.replace(", cast", "|cast").split("|"))


@R("pf14_rect_predicates", RECTS + "select id, xl <= 5000 and 5000 < xh and yl <= 4000 and 4000 < yh as holds, xl < 5000 and 0 < xh and yl < 4000 and 0 < yh as lower_left, xl < 10000 and 5000 < xh and yl < 4000 and 0 < yh as lower_right from r")
def _(spark, d):
    c = [F.col(x) for x in XY]
    box = lambda *v: [F.lit(x) for x in v]
    return rects(spark, d).select("id", G.contains(c, F.lit(5000), F.lit(4000)).alias("holds"), G.overlaps(c, box(0, 0, 5000, 4000)).alias("lower_left"), G.overlaps(c, box(5000, 0, 10000, 4000)).alias("lower_right"))


HIST = RECTS + ", c as (select r.*, unnest(range(greatest(xl // 100, 0), least((xh - 1) // 100, 99) + 1)) col from r), k as (select c.*, unnest(range(greatest(yl // 100, 0), least((yh - 1) // 100, 79) + 1)) as row from c)"


@R("ag30_histogram", HIST + "select col, row, count(*) as n from k group by col, row")
def _(spark, d):
    return G.histogram(rects(spark, d), [], XY, *BIN)


@R("ag31_layer_histogram", HIST + "select layer, col, row, count(*) as n from k group by layer, col, row")
def _(spark, d):
    return G.histogram(rects(spark, d), ["layer"], XY, *BIN)


@R("ag37_footprints", HIST + "select col, row, count(*) as n from k where layer <> 3 group by col, row")
def _(spark, d):
    return G.histogram(rects(spark, d).where("layer <> 3"), [], XY, *BIN)


@R("ag31_layer_totals", RECTS + "select layer, count(*) as n, cast(sum((xh - xl) * (yh - yl)) as bigint) as area from r group by layer")
def _(spark, d):
    return rects(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))).alias("area"))


SHARE = """, o as (select h.*, c, w, (least(xl + 100, c * 100 + 100) - greatest(xl, c * 100)) * (least(yl + 100, w * 100 + 100) - greatest(yl, w * 100)) ov
 from (select *, unnest(range(greatest(xl // 100, 0), least((xl + 99) // 100, 99) + 1)) c from h) h, lateral (select unnest(range(greatest(yl // 100, 0), least((yl + 99) // 100, 79) + 1)) w)),
s as (select *, v * ov // 10000 base, v * ov % 10000 rem from o where ov > 0), n as (select *, row_number() over (partition by id order by rem desc, w, c) k, v - sum(base) over (partition by id) lft from s)"""


@R("ag32_redistribute", RECTS + ", h as (select id, xl, yl, o % 97 + 1 as v from (select *, id o from r))" + SHARE + " select c as col, w as row, cast(sum(base + case when k <= lft then 1 else 0 end) as bigint) as n from n group by c, w")
@R("wn06_remainder_rank", RECTS + ", h as (select id, xl, yl, o % 97 + 1 as v from (select *, id o from r))" + SHARE + " select c as col, w as row, cast(sum(base + case when k <= lft then 1 else 0 end) as bigint) as n from n group by c, w")
def _(spark, d):
    h = rects(spark, d).select((F.col("id") % 97 + 1).alias("v"), "xl", "yl", (F.col("xl") + 100).alias("xh"), (F.col("yl") + 100).alias("yh"))
    return G.scatter(h, [], "v", XY, *BIN)


_bx = _turn("l.col * 100", "l.row * 100", "t.orient")
_bz = _turn("l.col * 100 + 100", "l.row * 100 + 100", "t.orient")
LOCAL = """, loc as (select i.block, i.dx // 100 as col, i.dy // 100 as row, count(*) as v from inst i where child is null group by all)"""


@R("ag36_hierarchical_histogram", DESIGN + LOCAL + f", h as (select row_number() over () id, v, least({_bx[0]}, {_bz[0]}) + t.dx xl, least({_bx[1]}, {_bz[1]}) + t.dy yl from tree t join loc l on t.block = l.block)" + SHARE.replace("99)", "199)", 1).replace("99) + 1)) c", "199) + 1)) c").replace("79)", "99)") + " select c as col, w as row, cast(sum(base + case when k <= lft then 1 else 0 end) as bigint) as n from n group by c, w")
def _(spark, d):
    loc = instances(spark, d).where("child is null").groupBy("block", F.call_function("div", "dx", F.lit(100)).alias("col"), F.call_function("div", "dy", F.lit(100)).alias("row")).agg(F.count(F.lit(1)).alias("v"))
    nodes, _ = broadcast_if_small(tree(spark, d).select("block", "dx", "dy", "orient"), 1_000_000, written=True)
    j = loc.join(nodes, "block")
    x, y = F.col("col") * 100, F.col("row") * 100
    b = G.place_box([x, y, x + 100, y + 100], F.col("dx"), F.col("dy"), F.col("orient"))
    return G.scatter(j.select("v", *(c.alias(n) for c, n in zip(b, XY))), [], "v", XY, (0, 0), (100, 100), (200, 100))


LOADS = HIST + ", g as (select col, row, layer, count(*) n from k group by all), m as (select col, row, cast(sum(n * case layer when 1 then 3 when 2 then 2 else 1 end) as double) as load from g group by col, row)"


def load_grid(spark: SparkSession, d: str) -> DataFrame:
    h = G.histogram(rects(spark, d), ["layer"], XY, *BIN)
    w = F.when(F.col("layer") == 1, 3.0).when(F.col("layer") == 2, 2.0).otherwise(1.0)
    return h.groupBy("col", "row").agg(F.sum(F.col("n") * w).alias("load"))


def marginals(spark: SparkSession, d: str) -> tuple[list[float], list[float]]:
    """Column and row loads; the grid is 100 x 80, so the driver holds 180 numbers."""
    g = cut(load_grid(spark, d))
    out = []
    for axis, n in (("col", 100), ("row", 80)):
        got = {r[0]: r[1] for r in g.groupBy(axis).agg(F.sum("load")).collect()}
        out.append([float(got.get(i, 0.0)) for i in range(n)])
    return out[0], out[1]


@R("ag33_marginals", LOADS + "select 'col' as axis, col as bin, sum(load) as load from m group by col union all select 'row', row, sum(load) from m group by row union all select 'all', -1, sum(load) from m")
def _(spark, d):
    g = load_grid(spark, d)
    part = lambda axis, c: g.groupBy(c.alias("bin")).agg(F.sum("load").alias("load")).select(F.lit(axis).alias("axis"), "bin", "load")
    return part("col", F.col("col")).unionByName(part("row", F.col("row"))).unionByName(g.agg(F.sum("load").alias("load")).select(F.lit("all").alias("axis"), F.lit(-1).cast("bigint").alias("bin"), "load"))


@R("ag34_spread", LOADS + """, cl as (select col i, sum(load) v from m group by 1), rl as (select row i, sum(load) v from m group by 1), s as (select (select 2 * sqrt(sum(v * i * i) / sum(v) - pow(sum(v * i) / sum(v), 2)) from cl) w, (select 2 * sqrt(sum(v * i * i) / sum(v) - pow(sum(v * i) / sum(v), 2)) from rl) h),
x as (select least(greatest(cast(floor(sqrt(12 * w / h) + 0.5) as bigint), 1), 12) nx from s) select nx, cast(ceil(12.0 / nx) as bigint) as ny from x""")
def _(spark, d):
    return spark.createDataFrame([G.grid_shape(12, *marginals(spark, d))], "nx bigint, ny bigint")


@R("wn03_prefix_cuts", LOADS + """, cl as (select i, coalesce(sum(load), 0) v from range(100) t(i) left join m on col = i group by i), a as (select i, sum(v) over (order by i) acc, sum(v) over () tot from cl),
ks as (select unnest(range(8)) k) select cast(k as integer) as k, case when k = 0 then 0 when k = 7 then 100 else coalesce((select min(i) + 1 from a where acc + tot * 1e-9 >= tot * k / 7), 100) end as cut from ks""")
def _(spark, d):
    full = spark.range(100).select(F.col("id").alias("i")).join(load_grid(spark, d).groupBy(F.col("col").alias("i")).agg(F.sum("load").alias("v")), "i", "left").fillna(0.0)
    return O.prefix_cuts(full, "i", "v", 7)


def parts(spark: SparkSession, d: str) -> list[tuple]:
    return G.decide_partitions(*marginals(spark, d), (0, 0), (100, 100), 20, count=12)


@R("ag35_partitions")
def _(spark, d):
    return spark.createDataFrame(parts(spark, d), "pid bigint, xl bigint, yl bigint, xh bigint, yh bigint, exl bigint, eyl bigint, exh bigint, eyh bigint")


#: The same decision with a given shape and even cuts, which SQL can follow.
GIVEN = [(j * 4 + i, i * 2500, j * 2000, i * 2500 + 2500, j * 2000 + 2000, G.INT_MIN if i == 0 else i * 2500 - 40, G.INT_MIN if j == 0 else j * 2000 - 40, G.INT_MAX if i == 3 else i * 2500 + 2540, G.INT_MAX if j == 3 else j * 2000 + 2040) for j in range(4) for i in range(4)]
PARTS = "p as (select * from (values " + ", ".join(str(tuple(x)) for x in GIVEN) + ") t(pid, cxl, cyl, cxh, cyh, exl, eyl, exh, eyh))"


@R("jn14_point_partition", RECTS + f", {PARTS} select r.id, cast(max(case when xl - 100 >= cxl and xl - 100 < cxh and yl >= cyl and yl < cyh then pid end) as bigint) as core, cast(coalesce(max(case when xl - 100 >= cxl and xl - 100 < cxh and yl >= cyl and yl < cyh then pid end), arg_min(pid, struct_pack(d := pow(greatest(cxl - (xl - 100), xl - 100 - cxh, 0), 2) + pow(greatest(cyl - yl, yl - cyh, 0), 2), p := pid))) as bigint) as primary_pid, count(*) filter (xl - 100 >= exl and xl - 100 < exh and yl >= eyl and yl < eyh) as n_copies from r, p group by r.id")
def _(spark, d):
    r = rects(spark, d).withColumn("x", F.col("xl") - 100)
    a = G.assign_points(r, "x", "yl", GIVEN)
    return a.select("id", "core", F.col("primary").alias("primary_pid"), F.size("copies").cast("bigint").alias("n_copies"))


@R("jn15_rect_overlap", RECTS + ", q as (select s_suppkey as sid, s_suppkey * 97 % 9000 as sxl, s_suppkey * 71 % 7000 as syl, s_suppkey * 97 % 9000 + 300 as sxh, s_suppkey * 71 % 7000 + 200 as syh from supplier) select id, sid from r join q on xl < sxh and sxl < xh and yl < syh and syl < yh")
def _(spark, d):
    q = table(spark, d, "supplier", "s_suppkey").selectExpr("s_suppkey sid", "s_suppkey * 97 % 9000 sxl", "s_suppkey * 71 % 7000 syl", "s_suppkey * 97 % 9000 + 300 sxh", "s_suppkey * 71 % 7000 + 200 syh")
    return G.overlap_join(rects(spark, d), q, XY, ("sxl", "syl", "sxh", "syh"), 250).select("id", "sid")


COPIES = RECTS + f", {PARTS}, g as (select pid, id from r, p where xl < exh and exl < xh and yl < eyh and eyl < yh)"


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles copied to every partition whose extended box they overlap."""
    return G.copies_of(rects(spark, d), XY, GIVEN).select("id", "pid")


@R("jn15_partition_copies", COPIES + "select id, cast(pid as bigint) as pid from g")
def _(spark, d):
    return copies(spark, d)


@R("jn16_follow_copies", COPIES + "select g.pid::bigint as pid, g.id, l_linenumber, l_partkey from g join lineitem on l_orderkey = g.id")
def _(spark, d):
    return copies(spark, d).join(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), F.col("id") == F.col("l_orderkey")).select("pid", "id", "l_linenumber", "l_partkey")


@R("ag46_crossing", COPIES + "select id, count(distinct pid) as n_partitions from g group by id having count(distinct pid) > 1")
def _(spark, d):
    return copies(spark, d).groupBy("id").agg(F.countDistinct("pid").alias("n_partitions")).where("n_partitions > 1")


@R("fn09_place_boxes", RECTS + f"select id, least({_turn('xl', 'yl', 'orient')[0]}, {_turn('xh', 'yh', 'orient')[0]}) + 7 as bxl, least({_turn('xl', 'yl', 'orient')[1]}, {_turn('xh', 'yh', 'orient')[1]}) - 3 as byl, greatest({_turn('xl', 'yl', 'orient')[0]}, {_turn('xh', 'yh', 'orient')[0]}) + 7 as bxh, greatest({_turn('xl', 'yl', 'orient')[1]}, {_turn('xh', 'yh', 'orient')[1]}) - 3 as byh from r")
def _(spark, d):
    b = G.place_box([F.col(c) for c in XY], F.lit(7), F.lit(-3), F.col("orient"))
    return rects(spark, d).select("id", *(c.alias(n) for c, n in zip(b, ("bxl", "byl", "bxh", "byh"))))


_p0, _p1 = _turn("-5", "-2", "orient"), _turn("xh - xl - 5", "yh - yl - 2", "orient")


@R("fn10_placement", RECTS + f"select id, xl - least({_p0[0]}, {_p1[0]}) as px, yl - least({_p0[1]}, {_p1[1]}) as py from r")
def _(spark, d):
    c = {n: F.col(n) for n in XY}
    p = G.placement(c["xl"], c["yl"], F.col("orient"), c["xh"] - c["xl"], c["yh"] - c["yl"], F.lit(5), F.lit(2))
    return rects(spark, d).select("id", p[0].alias("px"), p[1].alias("py"))


@R("fn11_segments", RECTS + ", w as (select id, [xl, xh, xh] xs, [yl, yl, yh] ys, orient * 2 + 3 as wd from r), s as (select *, unnest([1, 2]) i from w) select id, i - 1 as seg, least(xs[i], xs[i + 1]) - wd // 2 as sxl, least(ys[i], ys[i + 1]) - wd // 2 as syl, greatest(xs[i], xs[i + 1]) + wd // 2 as sxh, greatest(ys[i], ys[i + 1]) + wd // 2 as syh from s")
@R("ag38_wire_segments", RECTS + ", w as (select id, [xl, xh, xh] xs, [yl, yl, yh] ys, orient * 2 + 3 as wd from r), s as (select *, unnest([1, 2]) i from w) select id, i - 1 as seg, least(xs[i], xs[i + 1]) - wd // 2 as sxl, least(ys[i], ys[i + 1]) - wd // 2 as syl, greatest(xs[i], xs[i + 1]) + wd // 2 as sxh, greatest(ys[i], ys[i + 1]) + wd // 2 as syh from s")
def _(spark, d):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = rects(spark, d).withColumn("s", G.segments(F.array(pt("xl", "yl"), pt("xh", "yl"), pt("xh", "yh")), F.col("orient") * 2 + 3))
    return r.select("id", F.posexplode("s").alias("seg", "b")).select("id", "seg", F.col("b.xl").alias("sxl"), F.col("b.yl").alias("syl"), F.col("b.xh").alias("sxh"), F.col("b.yh").alias("syh"))


@R("fn12_via_array", RECTS + ", a as (select *, unnest(range(layer)) i from r), b as (select *, unnest(range(orient % 3 + 1)) j from a) select id, xl + i * 10 as x, yl + j * 12 as y from b")
def _(spark, d):
    v = G.via_array(F.col("xl"), F.col("yl"), F.col("layer"), F.col("orient") % 3 + 1, F.lit(10), F.lit(12))
    return rects(spark, d).select("id", F.explode(v).alias("v")).select("id", "v.x", "v.y")


@R("fn13_bbox", RECTS + "select layer, min(xl) as xl, min(yl) as yl, max(xh) as xh, max(yh) as yh, (max(xh) - min(xl)) * (max(yh) - min(yl)) as area from r group by layer")
def _(spark, d):
    b = rects(spark, d).groupBy("layer").agg(F.min("xl").alias("xl"), F.min("yl").alias("yl"), F.max("xh").alias("xh"), F.max("yh").alias("yh"))
    return b.withColumn("area", (F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl")))


# checks

@R("ag48_domain_check", FLAT + "select t.block, cast(sum(t.inst_count - 1) as bigint) as expected, cast(sum(coalesce(f.n, 0)) as bigint) as actual, cast(sum(t.inst_count - 1 - coalesce(f.d, 0)) as bigint) as holes, cast(sum(coalesce(f.n - f.d, 0)) as bigint) as duplicates from tree t left join (select node_id, count(*) n, count(distinct gid) d from flat group by 1) f on t.node_id = f.node_id group by t.block")
def _(spark, d):
    nodes = tree(spark, d)
    f = flat(spark, d, nodes).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gid").alias("d"))
    t = nodes.join(f, "node_id", "left").fillna(0, ["n", "d"]).withColumn("e", F.col("inst_count") - 1)
    return t.groupBy("block").agg(F.sum("e").alias("expected"), F.sum("n").alias("actual"), F.sum(F.col("e") - F.col("d")).alias("holes"), F.sum(F.col("n") - F.col("d")).alias("duplicates"))


@R("ag49_structure_check", DESIGN + f", {PARTS}, x as (select a.pid from p a join p b on a.pid < b.pid and a.cxl < b.cxh and b.cxl < a.cxh and a.cyl < b.cyh and b.cyl < a.cyh) select (select count(*) from x) as overlapping, (select cast(sum((cxh - cxl) * (cyh - cyl)) - (max(cxh) - min(cxl)) * (max(cyh) - min(cyl)) as bigint) from p) as uncovered, (select count(*) from (select path from tree group by path having count(*) > 1)) as repeated_paths")
def _(spark, d):
    p = spark.createDataFrame(GIVEN, "pid bigint, cxl bigint, cyl bigint, cxh bigint, cyh bigint, exl bigint, eyl bigint, exh bigint, eyh bigint")
    q = p.select(F.col("pid").alias("qid"), *(F.col(c).alias("q" + c) for c in ("cxl", "cyl", "cxh", "cyh")))
    over = G.overlap_join(p, q, ("cxl", "cyl", "cxh", "cyh"), ("qcxl", "qcyl", "qcxh", "qcyh"), 2500).where("pid < qid").agg(F.count(F.lit(1)).alias("overlapping"))
    area = p.agg((F.sum((F.col("cxh") - F.col("cxl")) * (F.col("cyh") - F.col("cyl"))) - (F.max("cxh") - F.min("cxl")) * (F.max("cyh") - F.min("cyl"))).alias("uncovered"))
    rep = tree(spark, d).groupBy("path").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_paths"))
    return over.crossJoin(one_row(area)).crossJoin(one_row(rep))  # three counts side by side


@R("ag50_cell_counts", DESIGN + "select block, count(*) as n, count(child) as n_blocks, count(*) filter (orient >= 4) as n_mirrored from inst group by block")
def _(spark, d):
    return instances(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count("child").alias("n_blocks"), F.count_if(F.col("orient") >= 4).alias("n_mirrored"))


@R("ag51_instantiations", DESIGN + "select block, count(*) as n, cast(sum(inst_count) as bigint) as size from tree group by block")
def _(spark, d):
    return tree(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("inst_count").alias("size"))


@R("pf17_placed_only", DESIGN + "select block, name, dx, dy from inst where child is null and orient <> 7")
def _(spark, d):
    return instances(spark, d).where("child is null and orient <> 7").select("block", "name", "dx", "dy")


@R("pf18_domain_filter", RECTS + "select layer, count(*) filter (abs(xl * 400000) <= 2147483647 and abs(xh * 400000) <= 2147483647) as kept, count(*) filter (not (abs(xl * 400000) <= 2147483647 and abs(xh * 400000) <= 2147483647)) as dropped from r group by layer")
def _(spark, d):
    inside = (F.abs(F.col("xl") * 400000) <= G.INT_MAX) & (F.abs(F.col("xh") * 400000) <= G.INT_MAX)
    return rects(spark, d).groupBy("layer").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@R("pf24_width_default", RECTS + "select id, cast(case when orient > 0 then orient else layer * 10 end as integer) as width from r where layer in (1, 2)")
def _(spark, d):
    layer = spark.createDataFrame([(1, 10), (2, 20)], "layer int, default_width int")
    return rects(spark, d).join(layer, "layer").select("id", F.when(F.col("orient") > 0, F.col("orient")).otherwise(F.col("default_width")).alias("width"))
