import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import spikes as S

from .conftest import rows

SCHEMA = "w bigint, t bigint, a bigint, b bigint, source string, chunk int"


def run(spark, data):
    df = spark.createDataFrame([(*x, "x", 1) for x in data], SCHEMA)
    bad = {"a": (F.col("a") < 0) | S.filler(F.col("a")), "b": F.col("b") > 10_000}
    return rows(S.wrong_readings(df, "w", "t", bad), "w", "t", "metric", "kind")


def noisy(n, seed=1, level=1000, sd=20):
    return np.random.default_rng(seed).normal(level, sd, n).astype(int)


def test_kinds_on_one_source(spark):
    a, b = noisy(400), noisy(400, 2)
    a[100:103] = 5000
    a[200] = 20
    a[300:312] = a[300]
    b[50] = 70_000
    data = [(1, i * 1000, int(a[i]), int(b[i])) for i in range(400)]
    data += [data[100], data[7]]  # rows sent twice
    got = run(spark, data)
    want = [(1, i * 1000, "a", "spike") for i in (100, 101, 102, 200)] + [(1, i * 1000, "a", "stuck") for i in range(300, 312)] + [(1, 50_000, "b", "range")]
    assert got == sorted(want)


def test_normal_shapes_give_no_cases(spark):
    n = 600
    rng = np.random.default_rng(3)
    step = np.where(np.arange(n) < 300, 1000, 4000) + rng.normal(0, 20, n)
    states = np.where((np.arange(n) // 12) % 2, 700, 5500) + rng.normal(0, 30, n)
    ramp = np.arange(n) * 30 % 6000 + rng.normal(0, 20, n)
    coarse = rng.choice([0, 100, 200], n, p=[0.6, 0.3, 0.1])
    data = [(1, i * 1000, int(step[i]), int(states[i])) for i in range(n)] + [(2, i * 1000, int(ramp[i]) + 100, int(coarse[i])) for i in range(n)] + [(3, i * 1000, 5, 5) for i in range(100)]
    assert run(spark, data) == []


def test_few_samples_nulls_and_empty(spark):
    assert run(spark, [(1, i, -5, None) for i in range(9)]) == []
    assert run(spark, []) == []
    data = [(1, i * 10, None if i % 3 else int(x), None) for i, x in enumerate(noisy(300))] + [(None, 1, -1, 1), (1, None, -1, 1)]
    assert run(spark, data) == []


def test_stretches_give_what_the_whole_source_gives(spark):
    rng = np.random.default_rng(5)
    n = 6000
    a = noisy(n, 6)
    for i in 40 * rng.choice(n // 40 - 1, 60, replace=False) + 20:
        a[i : i + rng.integers(1, 4)] += 700
    a[3024:3056] = a[3024]
    times = np.cumsum(rng.integers(200, 9000, n))
    data = [(1, int(times[i]), int(a[i]), None) for i in range(n)]
    got = {(t, k) for _, t, _, k in run(spark, data)}
    y, s = a.astype(float), S.scatter(a.astype(float))
    whole = {(int(times[i]), "spike") for i in np.flatnonzero(S.leaves_level(y, np.arange(n), s))} | {(int(times[i]), "stuck") for i in np.flatnonzero(S.stuck(a))}
    assert whole == got


@pytest.mark.parametrize("size", [8, 20, 333])
def test_sparse_part_finds_what_stands_out(size):
    z = np.random.default_rng(size).normal(0, 1, size)
    z[size // 2] += 40
    assert S.sparse_part(z)[size // 2]
    assert S.sparse_part(z).sum() <= 2 + size // 50


@pytest.mark.parametrize("n, at, size", [(6000, 2100, 2600), (6000, 1000, 1100), (10, 1, 8), (13, 5, 8), (60, 6, 48)])
def test_the_whole_of_a_frozen_run_counts(spark, n, at, size):
    a = 1000 + 7 * np.arange(n) % 1009
    a[at : at + size] = 5000
    data = [(1, i * 1000, int(a[i]), None) for i in range(n)]
    assert [t // 1000 for _, t, _, k in run(spark, data) if k == "stuck"] == list(range(at, at + size))
    assert np.flatnonzero(S.stuck(a)).tolist() == list(range(at, at + size))


def test_whether_a_metric_changes_is_judged_over_the_whole_source(spark):
    rng = np.random.default_rng(8)
    n = 5000
    a, b = np.arange(n), rng.choice([0, 100, 200], n, p=[0.6, 0.3, 0.1])
    a[900:] = 7  # idle for most of the time
    b[:1500] = np.arange(1500)  # coarse but for a part
    b[700:720] = 7
    data = [(1, i * 1000, int(a[i]), int(b[i])) for i in range(n)]
    assert not S.stuck(a).any()
    want = [(1, i * 1000, m, "stuck") for m, v in (("a", a), ("b", b)) for i in np.flatnonzero(S.stuck(v))]
    assert [r for r in run(spark, data) if r[3] == "stuck"] == sorted(want)


def test_rows_grow_in_line_with_the_readings_of_a_dense_half_hour(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("w"), F.col("id").alias("t"), (F.col("id") * 7919 % 1009 + 5000 + F.when(F.col("id") % 100_000 == 50_000, 90_000).otherwise(0)).alias("a"))
    seen = []
    judge = S._judge

    def counted(metrics):
        rows_of = spark.sparkContext.accumulator(0)
        seen.append(rows_of)
        inner = judge(metrics)

        def run(t):
            rows_of.add(t.num_rows)
            return inner(t)

        return run

    S._judge = counted
    try:
        got = rows(S.wrong_readings(df, "w", "t", {"a": F.col("a") < 0}), "t", "kind")
    finally:
        S._judge = judge
    assert got == [(k * 100_000 + 50_000, "spike") for k in range(10)]
    assert n < seen[0].value < 1.1 * n


def test_copies_do_not_use_up_the_neighbours_readings(spark):
    a = noisy(2100, 9)
    a[1022:1025] += 900
    data = [(1, i * 1000, int(a[i]), None) for i in range(2100) for _ in range(30 if 1000 <= i < 1050 else 1)]
    assert [t // 1000 for _, t, _, _ in run(spark, data)] == [1022, 1023, 1024]
    assert run(spark, [(1, i, 10 + 990 * (i == 4), None) for i in range(9) for _ in range(20)]) == []


def test_daily_profiles(spark):
    rng = np.random.default_rng(4)
    at = np.arange(0, 12 * 86_400_000, 300_000)
    slot = at // S.BUCKET_MS % S.SLOTS
    a = 3000 + 2000 * np.isin(slot, (9, 20, 33)) + 300 * np.sin(slot / 7) + rng.normal(0, 10, len(at))
    hit = [400, 1711, 2902]
    a[hit] += 900
    data = [(1, int(t), int(v), None) for t, v in zip(at, a)]
    assert [t // 300_000 for _, t, m, k in run(spark, data) if k == "spike"] == hit
    means = np.array([a[(at // S.BUCKET_MS) == k].mean() for k in range(12 * S.SLOTS)]).reshape(12, S.SLOTS)
    means[3, 5] += 4000
    means[7, :20] = np.nan
    low = S.day_levels(means)
    want = 3000 + 2000 * np.isin(np.arange(S.SLOTS), (9, 20, 33)) + 300 * np.sin(np.arange(S.SLOTS) / 7)
    assert np.abs(low - want)[np.arange(12) != 7].max() < 60 and np.abs(low - want).max() < 700
