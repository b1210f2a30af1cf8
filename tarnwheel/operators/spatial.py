"""Rectangles, placements, histograms on grids and load-balanced partitions.

Points and rectangles never meet each other pair by pair. Partitions cut both axes into ranges; a point finds its range
on each axis and meets the partitions of that cell only. Two large sides meet through the grid cells they touch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..session import one_row

INT_MIN, INT_MAX = -(2**31), 2**31 - 1

# Orientations: fixed values of the placement format. 0-3 turn left by so many quarters, 4-7 mirror x first.
ORIENTATIONS = ("N", "W", "S", "E", "FN", "FW", "FS", "FE")


def _quarters(o: Column) -> Column:
    return F.when(o < 4, o).otherwise((8 - o) % 4)


def compose_orient(a: Column, b: Column) -> Column:
    """The orientation of b, then a: quarters add up, or subtract behind a mirror; two mirrors cancel."""
    flip = (a >= 4) != (b >= 4)
    k = F.pmod(F.when(a >= 4, _quarters(a) - _quarters(b)).otherwise(_quarters(a) + _quarters(b)), F.lit(4))
    return F.when(flip, 4 + (4 - k) % 4).otherwise(k).cast("int")


def rotate(x: Column, y: Column, o: Column) -> tuple[Column, Column]:
    """(x, y) under orientation o alone."""
    x = F.when(o >= 4, -x).otherwise(x)
    k = _quarters(o)
    return F.when(k == 0, x).when(k == 1, -y).when(k == 2, -x).otherwise(y), F.when(k == 0, y).when(k == 1, x).when(k == 2, -y).otherwise(-x)


def place_point(x: Column, y: Column, dx: Column, dy: Column, o: Column) -> tuple[Column, Column]:
    rx, ry = rotate(x, y, o)
    return rx + dx, ry + dy


def place_box(box: Sequence[Column], dx: Column, dy: Column, o: Column) -> list[Column]:
    """(xl, yl, xh, yh) of the placed box, corners in order again."""
    ax, ay = place_point(box[0], box[1], dx, dy, o)
    bx, by = place_point(box[2], box[3], dx, dy, o)
    return [F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)]


def compose(dx: Column, dy: Column, o: Column, sx: Column, sy: Column, so: Column) -> list[Column]:
    """(dx, dy, orient) of the placement (sx, sy, so) within the placement (dx, dy, o)."""
    x, y = place_point(sx, sy, dx, dy, o)
    return [x, y, compose_orient(o, so)]


def placement(tx: Column, ty: Column, o: Column, width: Column, height: Column, ox: Column, oy: Column) -> list[Column]:
    """Offset that brings the lower left corner of the turned cell box to (tx, ty); the box starts at minus the origin."""
    b = place_box([-ox, -oy, width - ox, height - oy], F.lit(0), F.lit(0), o)
    return [tx - b[0], ty - b[1]]


def contains(rect: Sequence[Column], x: Column, y: Column) -> Column:
    """Half open: the low edges belong to the rectangle, the high ones do not."""
    return (rect[0] <= x) & (x < rect[2]) & (rect[1] <= y) & (y < rect[3])


def overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """A shared edge is no overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def segments(points: Column, width: Column) -> Column:
    """Array of boxes (xl, yl, xh, yh) of a polyline's segments, widened by half the width (rounded down) on every side."""
    h = F.floor(width / 2)
    n = F.size(points)
    pair = F.arrays_zip(F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    box = lambda p: F.struct(
        (F.least(p["a"]["x"], p["b"]["x"]) - h).alias("xl"), (F.least(p["a"]["y"], p["b"]["y"]) - h).alias("yl"),
        (F.greatest(p["a"]["x"], p["b"]["x"]) + h).alias("xh"), (F.greatest(p["a"]["y"], p["b"]["y"]) + h).alias("yh"),
    )
    return F.transform(pair, box)


def via_array(x: Column, y: Column, nx: Column, ny: Column, sx: Column, sy: Column) -> Column:
    """Array of the points of an nx by ny array with its steps, row by row."""
    one = F.lit(1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(ny, one) - 1), lambda j: F.transform(F.sequence(F.lit(0), F.greatest(nx, one) - 1), lambda i: F.struct((x + i * sx).alias("x"), (y + j * sy).alias("y")))))


def bins(lo: Column, hi: Column, origin: int, size: int, count: int) -> tuple[Column, Column]:
    """(first, last) bin that [lo, hi) touches, clipped to the grid; first > last where it touches none."""
    return F.greatest(floor_div(lo - origin, size), F.lit(0)), F.least(floor_div(hi - 1 - origin, size), F.lit(count - 1))


def histogram(df: DataFrame, keys: list[str], rect: Sequence[str], origin: tuple[int, int], size: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """(keys, col, row, n): rectangles that touch each bin of a grid; those outside count nowhere."""
    c = [F.col(r).cast("bigint") for r in rect]
    c0, c1 = bins(c[0], c[2], origin[0], size[0], shape[0])
    r0, r1 = bins(c[1], c[3], origin[1], size[1], shape[1])
    d = df.select(*keys, c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1")).where("c0 <= c1 and r0 <= r1")
    d = d.select(*keys, F.explode(F.sequence("c0", "c1")).alias("col"), "r0", "r1").select(*keys, "col", F.explode(F.sequence("r0", "r1")).alias("row"))
    return d.groupBy(*keys, "col", "row").agg(F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, keys: list[str], value: str, rect: Sequence[str], origin: tuple[int, int], size: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """(keys, col, row, n): whole counts of rectangles shared out over the bins of a grid by area.

    Each bin gets the rounded-down share of its overlap; what is left goes by ones to the bins with the largest
    remainders (ties by row, then column). What lies outside the grid is lost, but for those ones. Every
    rectangle must have a bin's area. The shares are made within the row, so only the sums are shuffled.
    """
    area = size[0] * size[1]
    c = [F.col(r).cast("bigint") for r in rect]
    c0, c1 = bins(c[0], c[2], origin[0], size[0], shape[0])
    r0, r1 = bins(c[1], c[3], origin[1], size[1], shape[1])
    d = df.where(F.col(value) != 0).select(*keys, F.col(value).cast("bigint").alias("_v"), *(x.alias(n) for x, n in zip((*c, c0, c1, r0, r1), ("xl", "yl", "xh", "yh", "c0", "c1", "r0", "r1")))).where("c0 <= c1 and r0 <= r1")

    def share(col: Column, row: Column) -> Column:
        gx, gy = col * size[0] + origin[0], row * size[1] + origin[1]
        over = (F.least(F.col("xh"), gx + size[0]) - F.greatest(F.col("xl"), gx)) * (F.least(F.col("yh"), gy + size[1]) - F.greatest(F.col("yl"), gy))
        part = F.col("_v") * over
        return F.struct((-(part % area)).alias("rest"), row.alias("row"), col.alias("col"), F.call_function("div", part, F.lit(area).cast("bigint")).alias("base"))

    cells = F.flatten(F.transform(F.sequence("r0", "r1"), lambda r: F.transform(F.sequence("c0", "c1"), lambda q: share(q, r))))
    d = d.withColumn("_a", F.array_sort(cells)).withColumn("_left", F.col("_v") - F.aggregate("_a", F.lit(0).cast("bigint"), lambda s, x: s + x["base"]))
    d = d.select(*keys, "_left", F.posexplode("_a").alias("_i", "_c"))
    d = d.select(*keys, "_c.col", "_c.row", (F.col("_c.base") + F.when(F.col("_i") < F.col("_left"), 1).otherwise(0)).alias("n"))
    return d.groupBy(*keys, "col", "row").agg(F.sum("n").alias("n"))


class Cuts:
    """The edges of partitions (pid, core xl yl xh yh, extended xl yl xh yh) on both axes, and what lies in the cells between.

    Partitions come from the driver, so what is made of them here is bounded by what it holds already.
    """

    def __init__(self, spark: SparkSession, parts: Sequence[tuple]):
        self.spark, self.parts = spark, [tuple(int(v) for v in p) for p in parts]
        self.xs, self.ys = (sorted({p[k + o] for p in self.parts for o in (0, 2, 4, 6)}) for k in (1, 2))
        self.nx, self.ny = ({v: i + 1 for i, v in enumerate(c)} for c in (self.xs, self.ys))

    @staticmethod
    def _range(v: Column, edges: list[int]) -> Column:
        """How many edges lie at or below v; a binary search, written as a tree of comparisons in the row's expression."""

        def tree(a: int, z: int) -> Column:
            if a == z:
                return F.lit(a)
            mid = (a + z) // 2
            return F.when(v >= edges[mid], tree(mid + 1, z)).otherwise(tree(a, mid))

        if len(edges) <= 256:
            return tree(0, len(edges))
        return F.size(F.filter(F.lit(edges), lambda e: e <= v))

    def x(self, v: Column) -> Column:
        return self._range(v, self.xs)

    def y(self, v: Column) -> Column:
        return self._range(v, self.ys)

    def _span(self, p: tuple, o: int) -> tuple[int, int, int, int]:
        return self.nx[p[o]], self.ny[p[o + 1]], self.nx[p[o + 2]], self.ny[p[o + 3]]

    def cells(self) -> DataFrame:
        """(_cx, _cy, _core, _held): of each cell the first partition whose core holds it, and the ids of those whose extended box does."""
        core: dict[tuple[int, int], int] = {}
        held: dict[tuple[int, int], list[int]] = {}
        for p in self.parts:
            a, b, c, d = self._span(p, 1)
            for i in range(a, c):
                for j in range(b, d):
                    core.setdefault((i, j), p[0])
            a, b, c, d = self._span(p, 5)
            for i in range(a, c):
                for j in range(b, d):
                    held.setdefault((i, j), []).append(p[0])
        rows = [(*k, core.get(k), sorted(set(held.get(k, [])))) for k in sorted(core.keys() | held.keys())]
        return self.spark.createDataFrame(rows, "_cx int, _cy int, _core bigint, _held array<bigint>")

    def extended(self) -> DataFrame:
        """(_cx, _cy, pid, _px, _py): the cells of each extended box, with its first one."""
        rows = [(i, j, p[0], a, b) for p in self.parts for a, b, c, d in [self._span(p, 5)] for i in range(a, c) for j in range(b, d)]
        return self.spark.createDataFrame(rows, "_cx int, _cy int, pid bigint, _px int, _py int")

    def nearest(self, df: DataFrame, px: Column, py: Column) -> tuple[DataFrame, Column]:
        """(df, the partition with the nearest core). Distances on an axis count up to 2**30; ties go to the smallest id.

        Where the cores make up a grid with ids in order, the nearest ranges of both axes are found apart; else every core is looked at.
        """
        cap = F.lit(1 << 30).cast("bigint")

        def away(lo: Column, hi: Column, v: Column) -> Column:
            return F.least(F.when(v < lo, lo - v).otherwise(F.greatest(v - hi, F.lit(0))), cap)

        cols, rows = sorted({(p[1], p[3]) for p in self.parts}), sorted({(p[2], p[4]) for p in self.parts})
        ids = {(p[1], p[3], p[2], p[4]): p[0] for p in self.parts}
        grid = [[ids.get((*c, *r)) for c in cols] for r in rows]
        flat = [v for r in grid for v in r]
        if None not in flat and len(self.parts) == len(flat) and flat == sorted(flat) and all(list(c) == sorted(c) for c in zip(*grid)):

            def first(ranges: list[tuple[int, int]], v: Column) -> Column:
                d = F.transform(F.arrays_zip(F.lit([r[0] for r in ranges]).cast("array<bigint>").alias("lo"), F.lit([r[1] for r in ranges]).cast("array<bigint>").alias("hi")), lambda r: away(r["lo"], r["hi"], v))
                return F.array_position(d, F.array_min(d)).cast("int")

            return df, F.element_at(F.lit(flat).cast("array<bigint>"), ((first(rows, py) - 1) * len(cols) + first(cols, px)).cast("int"))
        table = self.spark.createDataFrame([p[:5] for p in self.parts], "pid bigint, xl bigint, yl bigint, xh bigint, yh bigint")
        df = df.crossJoin(one_row(table.agg(F.collect_list(F.struct("*")).alias("_all"))))
        d2 = lambda p: away(p["xl"], p["xh"], px) * away(p["xl"], p["xh"], px) + away(p["yl"], p["yh"], py) * away(p["yl"], p["yh"], py)
        return df, F.array_min(F.transform("_all", lambda p: F.struct(d2(p).alias("d"), p["pid"].alias("pid"))))["pid"]


def assign_points(df: DataFrame, x: str, y: str, parts: Sequence[tuple]) -> DataFrame:
    """df with `core` (the partition whose core holds the point, or null), `primary` (that, else the one with the nearest core, ties by id) and `copies` (sorted ids of all whose extended box holds it, the primary among them).

    Any number of partitions; a point meets those of its own cell only, but for points outside all cores. At least one is needed.
    """
    if not len(parts):
        raise ValueError("no partitions")
    px, py = F.col(x).cast("bigint"), F.col(y).cast("bigint")
    cuts = Cuts(df.sparkSession, parts)
    d = df.withColumn("_cx", cuts.x(px)).withColumn("_cy", cuts.y(py)).join(cuts.cells(), ["_cx", "_cy"], "left")
    d, near = cuts.nearest(d, px, py)
    d = d.withColumn("core", F.col("_core")).withColumn("primary", F.coalesce("_core", near))
    held = F.coalesce("_held", F.array().cast("array<bigint>"))
    return d.withColumn("copies", F.array_sort(F.array_union(held, F.array("primary")))).select(*(F.col(f"`{c}`") for c in df.columns), "core", "primary", "copies")


def copies_of(df: DataFrame, rect: Sequence[str], parts: Sequence[tuple]) -> DataFrame:
    """df once for each partition whose extended box its rectangle overlaps, with `pid`; empty rectangles overlap nothing.

    A pair is kept in the lowest cell that both touch.
    """
    if not len(parts):
        raise ValueError("no partitions")
    cuts = Cuts(df.sparkSession, parts)
    c = [F.col(r).cast("bigint") for r in rect]
    d = df.where((c[0] < c[2]) & (c[1] < c[3])).withColumn("_x0", cuts.x(c[0])).withColumn("_y0", cuts.y(c[1]))
    d = d.withColumn("_cx", F.explode(F.sequence("_x0", cuts.x(c[2] - 1)))).withColumn("_cy", F.explode(F.sequence("_y0", cuts.y(c[3] - 1))))
    j = d.join(cuts.extended(), ["_cx", "_cy"])
    return j.where((F.col("_cx") == F.greatest("_x0", "_px")) & (F.col("_cy") == F.greatest("_y0", "_py"))).select(*(F.col(f"`{x}`") for x in df.columns), "pid")


def overlap_join(left: DataFrame, right: DataFrame, lrect: Sequence[str], rrect: Sequence[str], cell: int) -> DataFrame:
    """Pairs of rows whose rectangles overlap, each once; column names of the two sides must differ.

    A rectangle belongs to the level whose cells (of cell * 2**level) are at least as long as its longer side, so it touches
    four cells of it at most, whatever its size. Two rectangles meet in the cells of the higher one's level: each side goes to
    its own level and to the higher ones that the other side uses. A pair that shares several cells is kept in the one with
    the low corner of the overlap. Empty rectangles overlap nothing.
    """

    def levelled(df: DataFrame, rect: Sequence[str], name: str) -> DataFrame:
        c = [F.col(r).cast("bigint") for r in rect]
        side = F.greatest(c[2] - c[0], c[3] - c[1])
        level = F.greatest(F.lit(0), F.ceil(F.log2(side / cell)))  # one too low or too high by rounding does no harm
        return df.where((c[0] < c[2]) & (c[1] < c[3])).withColumn(name, level.cast("int"))

    l, r = levelled(left, lrect, "_ll"), levelled(right, rrect, "_rl")
    used = [sorted(x[0] for x in d.select(n).distinct().collect()) for d, n in ((l, "_ll"), (r, "_rl"))]  # 63 at most

    def touched(df: DataFrame, rect: Sequence[str], name: str, other: list[int]) -> DataFrame:
        c = [F.col(x).cast("bigint") for x in rect]
        above = F.filter(F.lit(other).cast("array<int>"), lambda k: k > F.col(name)) if other else F.array().cast("array<int>")
        d = df.withColumn("_k", F.explode(F.array_union(F.array(name), above)))
        size = F.lit(cell) * F.expr("shiftleft(1L, _k)")
        at = lambda v: F.call_function("div", v - F.pmod(v, size), size)
        d = d.withColumn("_cx", F.explode(F.sequence(at(c[0]), at(c[2] - 1))))
        return d.withColumn("_cy", F.explode(F.sequence(at(c[1]), at(c[3] - 1))))

    j = touched(l, lrect, "_ll", used[1]).join(touched(r, rrect, "_rl", used[0]), ["_k", "_cx", "_cy"]).where(F.col("_k") == F.greatest("_ll", "_rl"))
    a, b = [F.col(c).cast("bigint") for c in lrect], [F.col(c).cast("bigint") for c in rrect]
    size = F.lit(cell) * F.expr("shiftleft(1L, _k)")
    low = lambda x, y: F.call_function("div", F.greatest(x, y) - F.pmod(F.greatest(x, y), size), size)
    own = (low(a[0], b[0]) == F.col("_cx")) & (low(a[1], b[1]) == F.col("_cy"))
    return j.where(overlaps(a, b) & own).drop("_k", "_cx", "_cy", "_ll", "_rl")


# partition decision: on the marginals of a grid, which the driver holds


def spread(load: Sequence[float]) -> float:
    """Twice the load-weighted standard deviation of the position, at least 1."""
    total = sum(load)
    if total <= 0:
        return 1.0
    mean = sum(i * v for i, v in enumerate(load)) / total
    return max(2.0 * math.sqrt(sum(v * (i - mean) ** 2 for i, v in enumerate(load)) / total), 1.0)


def grid_shape(n: int, cols: Sequence[float], rows: Sequence[float]) -> tuple[int, int]:
    """(nx, ny) of about n partitions, in the ratio of the spreads."""
    nx = min(max(math.floor(math.sqrt(n * spread(cols) / spread(rows)) + 0.5), 1), n)
    return nx, -(-n // nx)


def cuts(load: Sequence[float], n: int) -> list[int]:
    """n + 1 cuts; cut k lies right of the first bin where the running sum reaches k/n, but for 1e-9 of the total."""
    total, out, acc = sum(load), [0], 0.0
    for c, v in enumerate(load):
        acc += v
        while len(out) < n and acc + total * 1e-9 >= total * len(out) / n:
            out.append(c + 1)
    return out + [len(load)] * (n + 1 - len(out))


def decide_partitions(
    cols: Sequence[float], rows: Sequence[float], origin: tuple[int, int], size: tuple[int, int], width: int, shape: str = "", count: int = 0, density: int = 0, default_density: int = 1_000_000
) -> list[tuple]:
    """Partitions (pid, core box, extended box) from the column and row loads of a grid.

    A valid shape `XxY` goes before count, count before target density. Without load there is one partition. Extended
    boxes reach twice `width` beyond inner sides and without bound beyond outer ones. Empty parts are left out.
    """
    if not len(cols) or not len(rows):
        return []
    total, want = sum(cols), None
    x, _, y = shape.partition("x")
    if total <= 0:
        want = (1, 1)
    elif x.isdigit() and y.isdigit() and int(x) >= 1 and int(y) >= 1:
        want = (int(x), int(y))
    elif count > 0:
        want = grid_shape(count, cols, rows) if count > 1 else (1, 1)
    else:
        n = min(max(1, math.ceil(total / (density if density > 0 else default_density))), len(cols) * len(rows))
        want = grid_shape(n, cols, rows) if n > 1 else (1, 1)
    cx, cy = cuts(cols, want[0]), cuts(rows, want[1])
    out: list[tuple] = []
    for j in range(want[1]):
        for i in range(want[0]):
            if cx[i + 1] <= cx[i] or cy[j + 1] <= cy[j]:
                continue
            xl, xh = (origin[0] + c * size[0] for c in cx[i : i + 2])
            yl, yh = (origin[1] + c * size[1] for c in cy[j : j + 2])
            ext = (INT_MIN if i == 0 else xl - 2 * width, INT_MIN if j == 0 else yl - 2 * width, INT_MAX if i == want[0] - 1 else xh + 2 * width, INT_MAX if j == want[1] - 1 else yh + 2 * width)
            out.append((len(out), xl, yl, xh, yh, *ext))
    return out
