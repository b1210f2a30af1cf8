import random

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import hierarchy as H

from .conftest import rows

BLOCKS = "block string, n_instances bigint, n_nets bigint, n_vias bigint"
INST = "block string, local_id bigint, name string, child string, dx bigint, dy bigint, orient int"


def tree(spark, blocks, inst):
    return H.build_tree(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(inst, INST))


def test_tree_ranges_and_transforms(spark):
    t = tree(spark, [("top", 3, 1, 2), ("mid", 2, 2, 0), ("low", 1, 0, 5)], [("top", 2, "b", "mid", 10, 0, 1), ("top", 1, "a", "mid", 0, 0, 0), ("top", 3, "leaf", None, 0, 0, 0), ("mid", 1, "x", "low", 5, 7, 4), ("mid", 2, "self", "mid", 0, 0, 0), ("low", 1, "c", "unknown", 0, 0, 0)])
    got = rows(t, "node_id", "parent_id", "path", "dx", "dy", "orient", "inst_start", "inst_count", "net_start", "via_start")
    assert got == [(0, 0, "", 0, 0, 0, 0, 4, 0, 0), (1, 0, "a", 0, 0, 0, 4, 3, 2, 2), (2, 1, "a/x", 5, 7, 4, 7, 2, 5, 2), (3, 0, "b", 10, 0, 1, 9, 3, 6, 7), (4, 3, "b/x", 3, 5, 7, 12, 2, 9, 7)]
    assert rows(H.global_instance(t)) == [(0, 0), (1, 1), (2, 5), (3, 2), (4, 10)]
    assert [r[1] for r in rows(H.children_order(t))] == ["top", "  a", "    x", "  b", "    x"]


@pytest.mark.parametrize("inst, word", [
    ([("a", 1, "x", "b", 0, 0, 0), ("b", 1, "y", "a", 0, 0, 0)], "no root"),
    ([], "more than one"),
    ([("a", 1, "x", "b", 0, 0, 0), ("b", 1, "y", "c", 0, 0, 0), ("c", 1, "z", "b", 0, 0, 0)], "cycle"),
])
def test_broken_hierarchies(spark, inst, word):
    with pytest.raises(ValueError, match=word):
        tree(spark, [("a", 1, 0, 0), ("b", 1, 0, 0), *([("c", 1, 0, 0)] if any(i[3] == "c" for i in inst) else [])], inst)


def test_no_blocks_give_an_empty_tree(spark):
    assert tree(spark, [], []).count() == 0


def test_global_ids_and_holes(spark):
    t = tree(spark, [("top", 1, 2, 2)], [("top", 1, "x", None, 0, 0, 0)])
    df = spark.createDataFrame([("top", i) for i in range(4)], "block string, k bigint")
    assert [r[0] for r in rows(H.to_global(t, df, "net", "k", "g"), "g")] == [1, 2]
    assert [r[0] for r in rows(H.to_global(t, df, "via", "k", "g"), "g")] == [0, 1]
    assert [r[0] for r in rows(H.to_global(t, df, "inst", "k", "g"), "g")] == [1]


def test_owner_of(spark):
    r = spark.createDataFrame([(0, 5, "a"), (5, 0, "none"), (70_000, 200_000, "b")], "s bigint, c bigint, n string")
    ids = spark.createDataFrame([(i,) for i in (-1, 0, 4, 5, 69_999, 70_000, 269_999, 270_000)], "id bigint")
    got = {x["id"]: x["n"] for x in H.owner_of(ids, "id", r, "s", "c", ["n"]).collect()}
    assert got == {-1: None, 0: "a", 4: "a", 5: None, 69_999: None, 70_000: "b", 269_999: "b", 270_000: None}


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        up[rb] = ra
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "single"])
def test_components(spark, kind):
    rnd = random.Random(7)
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)], "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)], "single": [(4, 4), (9, 9)]}[kind]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert rows(H.components(df), "id", "root") == brute(edges)


def test_nearest_match_prefers_fewer_hops_then_declaration(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 5, 0), (4, 6, 0)], "a bigint, b bigint, ord int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    assert rows(H.nearest_match(e, ids(1), ids(5, 6))) == [(1, 5, 2)]
    assert rows(H.nearest_match(e, ids(1), ids(4, 5))) == [(1, 4, 2)]
    assert rows(H.nearest_match(e, ids(1), ids(9))) == []


def test_depth_has_no_bound(spark):
    n = 80
    edges = spark.createDataFrame([(k, k + 1, 0) for k in range(n)], "a bigint, b bigint, ord bigint")
    hit = H.nearest_match(edges, spark.createDataFrame([(0,)], "id bigint"), spark.createDataFrame([(n,)], "id bigint"))
    assert rows(hit, "start", "id", "hops") == [(0, n, n)]


def test_running_sums_over_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    got = rows(H.running_sums(df, "n", ["v"], 3), "n", "v_before")
    assert got == [(k, sum(j % 7 for j in range(k))) for k in range(50)]
