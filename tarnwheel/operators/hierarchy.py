"""Trees of block definitions, id ranges, paths, and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .ordered import dense_ids, running_sums
from .spatial import compose

def build_tree(blocks: DataFrame, instances: DataFrame) -> DataFrame:
    """Nodes of the instance tree, one for each way to reach a definition from the root.

    blocks: block, n_instances, n_nets, n_vias; of repeated names the first row by n_instances counts. instances:
    block, local_id, name, child (null for leaves), dx, dy, orient. References to oneself or to definitions that are
    not given are leaves. Exactly one definition without a parent is the root; more or none, or a cycle, raise
    ValueError. Result: node_id (depth first, children by local_id), parent_id (the root's own id for itself), depth,
    block, name, path (names below the root), local_id, dx, dy, orient (composed from the root), inst_start, inst_count
    (instances and the block itself at 0), net_start, net_count (nets and a hole at 0), via_start, via_count.
    """
    spark = blocks.sparkSession
    b = blocks.groupBy("block").agg(F.min(F.struct("n_instances", "n_nets", "n_vias")).alias("s")).select("block", "s.*")
    e = instances.where("child is not null and child <> block").join(b.select(F.col("block").alias("child")), "child", "left_semi").join(b.select("block"), "block", "left_semi")
    e = cut(e.select("block", "child", "local_id", "name", "dx", "dy", "orient"))
    b = cut(b)
    roots = b.join(e.select(F.col("child").alias("block")).distinct(), "block", "left_anti").select("block").limit(2).collect()
    if not roots and b.isEmpty():
        return spark.createDataFrame([], _TREE)
    if len(roots) != 1:
        raise ValueError("the hierarchy has no root" if not roots else "the hierarchy has more than one root")
    zero = F.lit(0).cast("bigint")
    level = b.where(F.col("block") == roots[0]["block"]).select(
        "block", F.array().cast("array<bigint>").alias("key"), F.array("block").alias("seen"), F.lit("").alias("name"), F.lit("").alias("path"), zero.alias("local_id"), zero.alias("dx"), zero.alias("dy"), F.lit(0).alias("orient")
    )
    levels = [level]
    while True:
        p = level.select(F.col("block").alias("pb"), "key", "seen", "path", *(F.col(c).alias("p" + c) for c in ("dx", "dy", "orient")))
        nxt = p.join(e, p.pb == e.block)
        at = compose(F.col("pdx"), F.col("pdy"), F.col("porient"), F.col("dx").cast("bigint"), F.col("dy").cast("bigint"), F.col("orient"))
        nxt = cut(nxt.select(
            F.col("child").alias("block"), F.concat("key", F.array(F.col("local_id").cast("bigint"))).alias("key"), F.concat("seen", F.array("child")).alias("seen"), F.array_contains("seen", F.col("child")).alias("again"),
            "name", F.concat("path", F.when(F.col("path") == "", "").otherwise("/"), "name").alias("path"), F.col("local_id").cast("bigint").alias("local_id"), at[0].alias("dx"), at[1].alias("dy"), at[2].alias("orient"),
        ))
        n, again = nxt.agg(F.count(F.lit(1)), F.bool_or("again")).first()
        if not n:
            break
        if again:
            raise ValueError("the hierarchy has a cycle")
        level = nxt.drop("again")
        levels.append(level)
    t = levels[0]
    for x in levels[1:]:
        t = t.unionByName(x)
    t = cut(dense_ids(t.withColumn("depth", F.size("key")).drop("seen"), ["key"], "node_id"))
    up = t.select(F.col("key").alias("pkey"), F.col("node_id").alias("parent_id"))
    t = t.withColumn("pkey", F.when(F.size("key") > 0, F.slice("key", 1, F.greatest(F.size("key") - 1, F.lit(0)))).otherwise(F.col("key"))).join(up, "pkey").drop("pkey").join(b, "block")
    t = t.withColumn("inst_count", F.col("n_instances") + 1).withColumn("net_count", F.col("n_nets") + 1).withColumn("via_count", F.col("n_vias"))
    t = running_sums(t, "node_id", [f"{k}_count" for k in ("inst", "net", "via")])
    for k in ("inst", "net", "via"):
        t = t.withColumnRenamed(f"{k}_count_before", f"{k}_start")
    return cut(t.select("node_id", "parent_id", "depth", "block", "name", "path", "local_id", "dx", "dy", "orient", *(f"{k}_{x}" for k in ("inst", "net", "via") for x in ("start", "count"))))


_TREE = (
    "node_id bigint, parent_id bigint, depth int, block string, name string, path string, local_id bigint, dx bigint, dy bigint, orient int, "
    "inst_start bigint, inst_count bigint, net_start bigint, net_count bigint, via_start bigint, via_count bigint"
)


def global_instance(tree: DataFrame) -> DataFrame:
    """(node_id, self_id): the global id of each node's own instance, 0 for the root."""
    p = tree.select(F.col("node_id").alias("parent_id"), F.col("inst_start").alias("_s"))
    return tree.join(p, "parent_id").select("node_id", F.when(F.col("depth") == 0, 0).otherwise(F.col("_s") + F.col("local_id")).alias("self_id"))


def to_global(tree: DataFrame, rows: DataFrame, kind: str, local: str, out: str, carry: tuple[str, ...] = (), max_rows: int = 1_000_000) -> DataFrame:
    """Definition rows (block, local, ...) at every instantiation, with node_id, the global id and the node's `carry` columns.

    Instances: start + local, local 0 is the block itself and left out here; nets: start + local, 0 is a hole;
    vias: start + local - 1. Locals out of range are dropped.
    """
    t, _ = broadcast_if_small(tree.select("node_id", "block", F.col(f"{kind}_start").alias("_s"), F.col(f"{kind}_count").alias("_c"), *carry), max_rows, written=True)
    j = rows.join(t, "block")
    low, shift = F.col(local) >= 1, F.lit(1 if kind == "via" else 0)
    return j.where(low & (F.col(local) - shift < F.col("_c"))).withColumn(out, F.col("_s") + F.col(local) - shift).drop("_s", "_c")


def owner_of(ids: DataFrame, id_col: str, ranges: DataFrame, start: str, count: str, carry: list[str], block_bits: int = 16) -> DataFrame:
    """ids with the row of the range start <= id < start + count; null without one. Ranges must not overlap.

    Ranges are cut at the edges of blocks of ids and meet the ids by an equi join on the block.
    """
    r = ranges.where(F.col(count) > 0).select(F.col(start).alias("_s"), (F.col(start) + F.col(count)).alias("_e"), *carry)
    r = r.withColumn("_b", F.explode(F.sequence(F.shiftright("_s", block_bits), F.shiftright(F.col("_e") - 1, block_bits))))
    i = ids.withColumn("_b", F.shiftright(id_col, block_bits))
    j = i.select("_b", id_col).distinct().join(r, "_b").where((F.col("_s") <= F.col(id_col)) & (F.col(id_col) < F.col("_e")))
    return ids.join(j.select(id_col, *carry), id_col, "left")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): connected components of an edge list, root the smallest id; self edges name single members.

    Large and small stars in turn: each round links every node to the smallest it can see, in time and space of
    the number of edges, so a hot node costs an aggregate and no list. Each round is checkpointed.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = both.join(low, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    mark = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    was = mark(e)
    while True:
        e = cut(star(star(e, True), False))
        now = mark(e)
        if now == was:
            break
        was = now
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))


def rerooted(members: DataFrame, depths: DataFrame) -> DataFrame:
    """(id, root, size): each component under the member of the lowest depth, then the smallest id. depths: (id, depth)."""
    m = members.join(depths, "id", "left")
    best = m.groupBy("root").agg(F.min(F.struct("depth", "id")).getField("id").alias("best"), F.count(F.lit(1)).alias("size"))
    return members.join(best, "root").select("id", F.col("best").alias("root"), "size")


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hops): everything reached from start (id) along edges (a, b) in at most so many steps, with the fewest."""
    seen = cut(start.select("id").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(edges, front.id == edges.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(h))
        front = cut(nxt)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def nearest_match(edges: DataFrame, start: DataFrame, match: DataFrame) -> DataFrame:
    """(start, id, hops): for each start the nearest reachable match, by hops, then by the order of declaration along the way.

    edges: a, b, ord. A node reached twice keeps its first way; the search ends when nothing new is reached, at any depth.
    """
    seen = cut(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("way")))
    front, h = seen, 0
    while True:
        h += 1
        nxt = front.join(edges, front.id == edges.a).select("start", F.col("b").alias("id"), F.concat("way", F.array(F.col("ord").cast("bigint"))).alias("way"))
        nxt = nxt.groupBy("start", "id").agg(F.min("way").alias("way")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(nxt.select("start", "id", F.lit(h).alias("hops"), "way"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    hit = seen.where("hops > 0").join(match.select("id").distinct(), "id", "left_semi")
    return hit.groupBy("start").agg(F.min(F.struct("hops", "way", "id")).alias("m")).select("start", "m.id", "m.hops")


def children_order(tree: DataFrame) -> DataFrame:
    """The tree as indented lines in depth-first order."""
    return tree.select("node_id", F.concat(F.expr("repeat('  ', depth)"), F.when(F.col("depth") == 0, F.col("block")).otherwise(F.col("name"))).alias("line"))


