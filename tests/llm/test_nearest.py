import random

from pyspark.accumulators import AccumulatorParam

from tarnwheel.llm import nearest as N

from ..conftest import rows

L, R = "task bigint, w bigint, s bigint, e string, hit int", "w bigint, m bigint, t string"


def run(spark, left, right, tol=5000, **kw):
    l = spark.createDataFrame([(*x, "x", 1) for x in left], L)
    r = spark.createDataFrame([(*x, "x") for x in right], R)
    return rows(N.nearest_in_time(l, r, "w", "s", "m", tol, ["task"], "m", **kw), "task", "w", "s", "m")


def brute(left, right, tol=5000):
    out = set()
    for t, w, s in left:
        c = [(abs(m - s), m) for v, m in right if v == w and w is not None and m is not None and s is not None and abs(m - s) <= tol]
        if c:
            out.add((t, w, s, min(c)[1]))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_ties_tolerance_nulls_and_repeats(spark):
    left = [(1, 1, 10_000), (1, 1, 10_000), (2, 1, 20_000), (3, 2, 10_000), (4, None, 5), (5, 1, None), (None, 1, 30_000)]
    right = [(1, 9_000), (1, 11_000), (1, 11_000), (1, 25_000), (1, 34_999), (2, 15_001), (None, 5), (1, None)]
    got = N.nearest_in_time(spark.createDataFrame([(*x, "x", 1) for x in left], L), spark.createDataFrame([(*x, "x") for x in right], R), "w", "s", "m", 5000, ["task"], "m")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 1, 10_000, 9_000), (2, 1, 20_000, 25_000), (None, 1, 30_000, 34_999)], key=str)


def test_random_with_a_hot_entity_over_many_groups(spark):
    rnd = random.Random(1)
    w = lambda: 17 if rnd.random() < 0.5 else rnd.randrange(4)
    left = [(i, w(), rnd.randrange(20_000_000)) for i in range(1500)]
    right = [(w(), rnd.randrange(20_000_000)) for _ in range(4000)]
    left += [(9999, 17, k * N.WIDTHS_MS[0]) for k in range(1, 5)]
    right += [(17, k * N.WIDTHS_MS[0] - 3) for k in range(1, 5)]
    assert run(spark, left, right, group_rows=300) == brute(left, right)


def test_filler_times(spark):
    top = 2**63 - 1
    assert run(spark, [(1, 1, top), (2, 1, -top)], [(1, top - 4), (1, -top), (1, 0)]) == [(1, 1, top, top - 4), (2, 1, -top, -top)]


def test_empty_sides(spark):
    assert run(spark, [], [(1, 5)]) == [] and run(spark, [(1, 1, 5)], []) == [] and run(spark, [], []) == []


def test_any_tolerance(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randrange(3), rnd.randrange(-40_000_000, 90_000_000)) for i in range(300)]
    right = [(rnd.randrange(3), rnd.randrange(-40_000_000, 90_000_000)) for _ in range(40)]
    for tol in (0, 3_600_000, 10**12):
        assert run(spark, left, right, tol) == brute(left, right, tol)


def test_a_dense_half_hour_is_cut(spark, monkeypatch):
    rnd = random.Random(5)
    left = [(i, 17, rnd.randrange(1_000, 3_000)) for i in range(3000)] + [(i, 17, 2_000) for i in range(4000, 5000)]
    left += [(i, 17, rnd.randrange(20_000_000)) for i in range(6000, 6300)]
    right = [(17, rnd.randrange(900, 3_100)) for _ in range(2000)] + [(17, 2_500)] * 1500 + [(17, rnd.randrange(20_000_000)) for _ in range(200)]
    most = spark.sparkContext.accumulator(0, Most())
    match = N._match

    def watched(tolerance, columns):
        inner = match(tolerance, columns)

        def f(lt, rt):
            most.add(lt.num_rows + rt.num_rows)
            return inner(lt, rt)

        return f

    monkeypatch.setattr(N, "_match", watched)
    assert run(spark, left, right, 500, group_rows=150) == brute(left, right, 500)
    assert 0 < most.value < 1500


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)
