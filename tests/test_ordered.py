import random

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import filters as P
from tarnwheel.operators import ordered as O

from .conftest import rows


def test_latest_and_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")], "k int, t int, v string")
    assert rows(O.latest(df, ["k"], ["t"]), "k", "v") == [(1, "b"), (2, "d")]
    assert rows(O.latest(df.where("k = 1"), ["k"], ["t"], first=True), "v") == [("c",)]


def test_previous_row_across_shards(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(3), t) for t in rnd.sample(range(10_000), 300)]
    df = spark.createDataFrame(data, "k int, t bigint")
    want = []
    for k in range(3):
        ts = sorted(t for q, t in data if q == k)
        want += [(t, p) for t, p in zip(ts, [-1, *ts])]
    assert rows(O.with_previous(df, "k", "t", ["t"], shard=500).select("t", F.coalesce("prev_t", F.lit(-1)))) == sorted(want)


def test_asof_across_shards_against_brute_force(spark):
    rnd = random.Random(5)
    left = [(rnd.randrange(3), rnd.randrange(5000), i) for i in range(200)] + [(None, 5, 900), (1, None, 901)]
    right = [(rnd.randrange(3), rnd.randrange(5000), rnd.randrange(9)) for _ in range(60)] + [(1, None, 1), (None, 7, 1)]
    l, r = spark.createDataFrame(left, "k int, t bigint, v bigint"), spark.createDataFrame(right, "k int, m bigint, v bigint")
    want = {}
    for k, t, i in left:
        c = [(m, v) for q, m, v in right if q == k and k is not None and t is not None and m is not None and m <= t]
        want[i] = max(c) if c else (None, None)
    got = {x["v"]: (x["asof_m"], x["asof_v"]) for x in O.asof(l, r, "k", "t", "m", ["m", "v"], shard=300).collect()}
    assert got == want
    near = {x["v"]: x["asof_m"] for x in O.asof(l, r, "k", "t", "m", ["m"], max_age=20, shard=300).collect()}
    times = {i: t for _, t, i in left}
    assert near == {i: m if m is not None and times[i] - m <= 20 else None for i, (m, _) in want.items()}
    assert O.asof(l, r.limit(0), "k", "t", "m", ["v"]).where("asof_v is null").count() == 202


def test_rates_after_a_restart(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 1000, 400), (1, 3000, 50)], "k int, t bigint, c bigint")
    assert rows(O.rates(df, "k", "t", "c").select("t", F.coalesce("rate", F.lit(-1.0)))) == [(0, -1.0), (1000, 300.0), (3000, 0.0)]


def test_carried_forward(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2000, 12), (2, 1000, 5)], "k int, t bigint, v bigint")
    assert rows(O.carried(df, "k", "t", ["v"], 1000), "bucket", "k", "v", "fresh") == [(0, 1, 10, True), (1, 1, 10, False), (1, 2, 5, True), (2, 1, 12, True), (2, 2, 5, False)]


def test_as_of_totals_with_a_death(spark):
    df = spark.createDataFrame([(1, 10, 7), (1, 20, 9)], "k int, t bigint, v bigint")
    ends = spark.createDataFrame([(1, 25)], "k int, end_ms bigint")
    assert rows(O.totals_at_ticks(df, "k", "t", "v", 15)) == [(15, 7), (30, 9)]
    assert rows(O.totals_at_ticks(df, "k", "t", "v", 15, ends)) == [(15, 7), (30, 0)]
    assert rows(O.totals_at_ticks(df, "k", "t", "v", 15, ends, drop_before_end=True)) == []


@pytest.mark.parametrize("n, phases", [(9, 1), (10, 10)])
def test_phases(spark, n, phases):
    assert O.phases(spark.range(n).select((F.col("id") * 100).alias("t"), F.lit(5).alias("v")), "t", "v").count() == phases


def test_quota(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, i int")
    assert O.quota(df, "k", ["i"], F.lit(2)).count() == 3
    assert O.quota(df, "k", ["i"], F.lit(-1)).count() == 6
    assert O.quota(df, "k", ["i"], F.lit(0)).count() == 0


def test_decay_by_hours_equals_row_by_row(spark):
    data = [(0, 10.0), (100, 5.0), (7300, 2.0)]
    got = O.decayed(spark.createDataFrame([(1, *d) for d in data], "k int, t bigint, v double"), "k", "t", ["v"], 0.001).first()
    assert got["last_s"] == 7300 and abs(got["v"] - sum(v * 0.999 ** (7300 - t) for t, v in data)) < 1e-9


def test_dense_ids_and_running_totals(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "a int")
    assert rows(O.dense_ids(df, ["a"], "id", 1), "a", "id") == [(i, i + 1) for i in range(50)]
    assert [r[1] for r in rows(O.running_before(df, ["a"], "a"), "a", "before")][:5] == [0, 0, 1, 3, 6]


def test_prefix_cuts(spark):
    df = spark.createDataFrame([(0, 124.0), (1, 4.0), (2, 64.0), (3, 4.0)], "i bigint, v double")
    assert [r[1] for r in rows(O.prefix_cuts(df, "i", "v", 2))] == [0, 1, 4]
    assert [r[1] for r in rows(O.prefix_cuts(df, "i", "v", 8))] == [0, 1, 1, 1, 1, 1, 3, 3, 4]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(i, i % 3, "my_task" if i % 2 else "other") for i in range(10)], "task_id int, v int, name string")
    assert df.where(P.like("name", "MY")).count() == 5 and df.where(P.like("name", "y_t", escape=True)).count() == 5
    assert P.parse_cursors("1:5,x:2,3,4:y,7:8") == [(1, 5), (7, 8)]
    got = P.page(df, {"v": F.col("v")}, "v", False, "task_id", 0, -3).collect()
    assert [(r["task_id"], r["total"]) for r in got] == [(9, 10)]
    assert P.page(df, {"v": F.col("v")}, "v", True, "task_id", 5000).count() == 10
    assert [r["task_id"] for r in P.page(df, {"v": F.col("v")}, "v", True, "task_id", 3).collect()] == [8, 5, 2]
    cur = spark.createDataFrame([(0, 3), (1, 100)], "v int, cursor int")
    assert rows(P.after_cursors(df, cur, "v", "task_id"), "task_id") == [(6,), (9,)]
