import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import spatial as G

from .conftest import rows


def test_all_64_compositions_are_homomorphic(spark):
    df = spark.range(8).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("b")))
    x, y = F.lit(3), F.lit(11)
    bx, by = G.rotate(x, y, F.col("b"))
    abx, aby = G.rotate(bx, by, F.col("a"))
    cx, cy = G.rotate(x, y, G.compose_orient(F.col("a"), F.col("b")))
    got = df.select(abx.alias("p"), aby.alias("q"), cx.alias("r"), cy.alias("s")).collect()
    assert len(got) == 64 and all((r["p"], r["q"]) == (r["r"], r["s"]) for r in got)


@pytest.mark.parametrize("o, want", list(enumerate([(1, 2), (-2, 1), (-1, -2), (2, -1), (-1, 2), (2, 1), (1, -2), (-2, -1)])))
def test_orientations(spark, o, want):
    x, y = G.rotate(F.lit(1), F.lit(2), F.lit(o))
    assert tuple(spark.range(1).select(x, y).first()) == want


def test_edges_of_rectangles(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    a = spark.range(1).select(G.overlaps(lit(0, 0, 10, 10), lit(10, 0, 20, 10)), G.overlaps(lit(0, 0, 10, 10), lit(9, 9, 20, 20)), G.contains(lit(0, 0, 10, 10), F.lit(0), F.lit(9)), G.contains(lit(0, 0, 10, 10), F.lit(10), F.lit(0)))
    assert tuple(a.first()) == (False, True, True, False)


@pytest.mark.parametrize("rects, want", [
    ([(1000, 50, 0, 150, 100), (1, 0, 0, 100, 100)], {(0, 0): 501, (1, 0): 500}),
    ([(1, 25, 0, 125, 100), (1, 0, 0, 100, 100)], {(0, 0): 2}),
    ([(1, 50, 0, 150, 100), (1, 0, 0, 100, 100)], {(0, 0): 2}),
    ([(5, 500, 0, 600, 100)], {}),
    ([(0, 0, 0, 100, 100)], {}),
])
def test_scatter(spark, rects, want):
    df = spark.createDataFrame(rects, "v bigint, xl bigint, yl bigint, xh bigint, yh bigint")
    got = {(r["col"], r["row"]): r["n"] for r in G.scatter(df, [], "v", ("xl", "yl", "xh", "yh"), (0, 0), (100, 100), (2, 1)).collect() if r["n"]}
    assert got == want


def test_scatter_keeps_totals_inside(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(1, 99), x, y, x + 100, y + 100) for x, y in ((rnd.randrange(900), rnd.randrange(900)) for _ in range(200))]
    df = spark.createDataFrame(data, "v bigint, xl bigint, yl bigint, xh bigint, yh bigint")
    got = G.scatter(df, [], "v", ("xl", "yl", "xh", "yh"), (0, 0), (100, 100), (10, 10)).agg(F.sum("n")).first()[0]
    assert got == sum(d[0] for d in data)


def test_histogram_clips_and_counts_negative_sides(spark):
    df = spark.createDataFrame([(-150, 0, 50, 100), (100, 0, 200, 1)], "xl bigint, yl bigint, xh bigint, yh bigint")
    assert rows(G.histogram(df, [], ("xl", "yl", "xh", "yh"), (-100, 0), (100, 100), (3, 1))) == [(0, 0, 1), (1, 0, 1), (2, 0, 1)]


def test_overlap_join_against_brute_force(spark):
    rnd = random.Random(3)
    box = lambda: (x := rnd.randrange(-500, 500), y := rnd.randrange(-500, 500), x + rnd.randrange(0, 90), y + rnd.randrange(0, 90))
    a, b = [(i, *box()) for i in range(150)], [(i, *box()) for i in range(150)]
    l = spark.createDataFrame(a, "i int, xl bigint, yl bigint, xh bigint, yh bigint")
    r = spark.createDataFrame(b, "j int, uxl bigint, uyl bigint, uxh bigint, uyh bigint")
    want = sorted((p[0], q[0]) for p, q in itertools.product(a, b) if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    assert rows(G.overlap_join(l, r, ("xl", "yl", "xh", "yh"), ("uxl", "uyl", "uxh", "uyh"), 64), "i", "j") == want


def test_points_outside_all_cores_go_to_the_nearest(spark):
    parts = [(0, 0, 0, 100, 100, -5, -5, 110, 105), (1, 100, 0, 200, 100, 90, -5, 205, 105)]
    df = spark.createDataFrame([(50, 50), (100, 50), (95, 1), (200, 10), (100, 500), (-9, 0)], "x int, y int")
    got = [(r["x"], r["primary"], list(r["copies"])) for r in G.assign_points(df, "x", "y", parts).collect()]
    assert got == [(50, 0, [0]), (100, 1, [0, 1]), (95, 0, [0, 1]), (200, 1, [1]), (100, 0, [0]), (-9, 0, [0])]


def test_partition_decision():
    p = G.decide_partitions([9, 30, 2, 17, 12], [41, 29], (50, 0), (80, 80), 25, shape="2x1")
    assert [(x[1], x[3]) for x in p] == [(50, 210), (210, 450)]
    assert [(x[5], x[7]) for x in p] == [(G.INT_MIN, 260), (160, G.INT_MAX)]
    assert len(G.decide_partitions([0, 0], [0], (0, 0), (1, 1), 1, shape="2x1")) == 1
    assert len(G.decide_partitions([5, 5], [5, 5], (0, 0), (1, 1), 1, shape="axb", count=4)) == 4
    assert G.decide_partitions([], [], (0, 0), (1, 1), 1) == []
    assert len(G.decide_partitions([5, 5, 5, 5], [20], (0, 0), (1, 1), 0, density=11)) == 2


def test_segments_and_via_arrays(spark):
    pts = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (10, 0), (10, 5))))
    s = spark.range(1).select(G.segments(pts, F.lit(5))).first()[0]
    assert [tuple(x) for x in s] == [(-2, -2, 12, 2), (8, -2, 12, 7)]
    v = spark.range(1).select(G.via_array(F.lit(0), F.lit(0), F.lit(2), F.lit(2), F.lit(3), F.lit(4))).first()[0]
    assert [tuple(x) for x in v] == [(0, 0), (3, 0), (0, 4), (3, 4)]


def brute_points(points, parts):
    away = lambda lo, hi, v: min(lo - v if v < lo else max(v - hi, 0), 1 << 30)
    out = []
    for x, y in points:
        core = next((p[0] for p in parts if p[1] <= x < p[3] and p[2] <= y < p[4]), None)
        near = min((away(p[1], p[3], x) ** 2 + away(p[2], p[4], y) ** 2, p[0]) for p in parts)[1]
        primary = near if core is None else core
        out.append((x, y, core, primary, sorted({primary} | {p[0] for p in parts if p[5] <= x < p[7] and p[6] <= y < p[8]})))
    return sorted(out, key=str)


def test_points_and_rectangles_against_every_partition(spark):
    rnd = random.Random(6)
    grid = [(j * 3 + i, i * 50, j * 40, i * 50 + 50, j * 40 + 40, i * 50 - 7, j * 40 - 7, i * 50 + 57, j * 40 + 47) for j in range(4) for i in range(3)]
    loose = [(k, *(a := (rnd.randrange(100), rnd.randrange(100))), a[0] + 20, a[1] + 30, a[0] - 5, a[1] - 5, a[0] + 25, a[1] + 40) for k in range(9)]
    points = [(rnd.randrange(-60, 220), rnd.randrange(-60, 220)) for _ in range(300)] + [(50, 200), (-9, 40), (2**40, 7), (-(2**40), -(2**40)), (100, 160)]
    boxes = [(i, x, y, x + rnd.randrange(0, 120), y + rnd.randrange(0, 90)) for i, (x, y) in enumerate(points[:200])]
    df, r = spark.createDataFrame([(*p, 5) for p in points], "x bigint, y bigint, _core int"), spark.createDataFrame(boxes, "i int, xl bigint, yl bigint, xh bigint, yh bigint")
    for parts in (grid, loose):
        got = [(t["x"], t["y"], t["core"], t["primary"], list(t["copies"])) for t in G.assign_points(df.drop("_core"), "x", "y", parts).collect()]
        assert sorted(got, key=str) == brute_points(points, parts)
        want = sorted((b[0], p[0]) for b in boxes for p in parts if b[1] < b[3] and b[2] < b[4] and b[1] < p[7] and p[5] < b[3] and b[2] < p[8] and p[6] < b[4])
        assert rows(G.copies_of(r, ("xl", "yl", "xh", "yh"), parts), "i", "pid") == want


def test_five_thousand_partitions(spark):
    parts = [(j * 100 + i, i * 10, j * 10, i * 10 + 10, j * 10 + 10, i * 10 - 2, j * 10 - 2, i * 10 + 12, j * 10 + 12) for j in range(50) for i in range(100)]
    df = spark.range(2000).select((F.col("id") * 7 % 1010).alias("x"), (F.col("id") * 13 % 505).alias("y"))
    got = [(t["x"], t["y"], t["core"], t["primary"], list(t["copies"])) for t in G.assign_points(df, "x", "y", parts).collect()]
    assert sorted(got[:40], key=str) == brute_points([(g[0], g[1]) for g in got[:40]], parts) and len(got) == 2000


def test_rectangles_of_all_sizes_overlap_as_in_a_full_comparison(spark):
    rnd = random.Random(11)
    make = lambda n: [(i, x := rnd.randrange(-5000, 5000), y := rnd.randrange(-5000, 5000), x + rnd.choice([0, 1, 7, 300, 9000]), y + rnd.choice([1, 5, 64, 2000])) for i in range(n)]
    a, b = make(150), [*make(120), (999, -(2**40), -(2**40), 2**40, 2**40)]
    l = spark.createDataFrame(a, "i int, xl bigint, yl bigint, xh bigint, yh bigint")
    r = spark.createDataFrame(b, "j int, uxl bigint, uyl bigint, uxh bigint, uyh bigint")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] < p[3] and max(p[1], q[1]) < min(p[3], q[3]) and q[1] < q[3] and max(p[2], q[2]) < min(p[4], q[4]))
    assert rows(G.overlap_join(l, r, ("xl", "yl", "xh", "yh"), ("uxl", "uyl", "uxh", "uyh"), 64), "i", "j") == want
    assert G.overlap_join(l.limit(0), r, ("xl", "yl", "xh", "yh"), ("uxl", "uyl", "uxh", "uyh"), 64).count() == 0
