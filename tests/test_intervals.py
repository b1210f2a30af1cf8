import random

from pyspark.sql import functions as F

from tarnwheel.operators import intervals as I

from .conftest import rows

SCHEMA = "w bigint, s bigint, e bigint, entity string, bits int"


def brute(data, limit=None):
    out, by = [], {}
    for w, s, e in data:
        if w is not None and s is not None and e is not None and e > s >= 0:
            by.setdefault(w, []).append((s, e))
    for w, x in by.items():
        merged = []
        for s, e in sorted(x):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(w, "period", s, e) for s, e in merged]
        out += [(w, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if limit is None or b[0] - a[1] <= limit]
    return sorted(out)


def run(spark, data, limit=None):
    df = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)
    return rows(I.periods_and_gaps(df, "w", "s", "e", limit), "w", "kind", "start_ms", "end_ms")


def test_touching_nested_repeated_and_null_rows(spark):
    data = [(1, 10, 20), (1, 20, 30), (1, 12, 15), (1, 40, 50), (1, 40, 50), (2, 5, 6), (None, 1, 2), (1, None, 3), (1, 3, None), (1, 9, 9), (1, 8, 7)]
    assert run(spark, data) == brute(data)


def test_intervals_over_many_shards(spark):
    b = 1 << I.SHARD_BITS
    data = [(1, b - 5, b), (1, b, b + 1), (1, 2 * b, 5 * b), (1, 5 * b, 5 * b + 3), (1, 7 * b + 1, 7 * b + 2), (1, 9 * b, 10 * b)]
    assert run(spark, data) == brute(data)


def test_random_against_brute_force_with_a_hot_entity(spark):
    rnd = random.Random(4)
    data = []
    for _ in range(3000):
        s = rnd.randrange(0, 60_000_000)
        data.append((7 if rnd.random() < 0.5 else rnd.randrange(5), s, s + rnd.choice([1, 50, 3000, 90_000])))
    assert run(spark, data, 100_000) == brute(data, 100_000)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = I.periods_and_gaps(df, "w", "s", "e")
    assert out.columns == ["w", "kind", "start_ms", "end_ms"] and out.count() == 0


def test_one_long_interval_in_thousands_of_rows(spark):
    df = spark.range(20_000).select(F.lit(1).alias("w"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 10).alias("e"))
    assert rows(I.periods_and_gaps(df, "w", "s", "e"), "kind", "start_ms", "end_ms") == [("period", 0, 200_000)]


def test_filler_ends_and_starts(spark):
    top = 2**63 - 1
    data = [(1, 10, top), (1, 50, 60), (2, 5, 6), (2, 100, 300), (2, 299, 400), (3, 390, 391)]
    assert run(spark, data) == brute(data)
    data += [(4, top - 5, top), (4, 7, 8), (4, 9, top - 9), (5, 1, top)]
    assert run(spark, data) == brute(data)


def test_filled_shards_hide_what_lies_inside(spark):
    rnd = random.Random(9)
    b = 1 << I.SHARD_BITS
    data = [(1, 5, 70_000 * b + 9), (1, 3 * b + 1, 3 * b + 2), (1, 3 * b + 5, 3 * b + 7), (1, 3 * b + 9, 3 * b + 12), (1, 70_000 * b + 20, 70_000 * b + 30), (1, 0, 2)]
    assert run(spark, data) == brute(data)
    for _ in range(1500):
        s = rnd.choice([rnd.randrange(0, 60 * b), b * rnd.randrange(60)])
        data.append((rnd.choice([2, 2, 3, 4, 5]), s, s + rnd.choice([1, 50, b // 9, b, 2 * b - rnd.randrange(3), 3 * b + 7])))
    data += [(6, k * b, (k + 1) * b) for k in range(9)] + [(7, 2 * b, 4 * b), (7, 4 * b + 1, 4 * b + 2), (7, 4 * b + 5, 5 * b), (7, 5 * b, 6 * b), (7, 8 * b, 9 * b)]
    assert run(spark, data) == brute(data)


def test_one_interval_is_a_bounded_number_of_rows():
    import numpy as np
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(np.full(3, 1)), pa.array([0, 7, 1 << 22]), pa.array([2**63 - 1, 2**60, 1 << 23])], names=["entity", "s", "e"])
    assert sum(x.num_rows for x in I._bitmaps(iter([b]))) <= 6
