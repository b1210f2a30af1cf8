from tarnwheel.operators import references as R

from .conftest import rows

REFS = "ref_table string, key bigint, ref_id bigint, time_ms bigint, k string, missing int"
PARENTS = "key bigint, from_ms bigint, to_ms bigint, block string"


def run(spark, refs, parents, limit=1000):
    r = spark.createDataFrame([(*x, "z", 1) for x in refs], REFS)
    p = spark.createDataFrame([(*x, "z") for x in parents], PARENTS)
    return rows(R.orphans(r, p, limit), "ref_table", "period", "key", "ref_id", "kind")


DAY = 86_400_000


def test_kinds_nulls_and_repeats(spark):
    refs = [("a", 1, 10, 5), ("a", 1, 10, 5), ("a", 2, 11, DAY), ("b", 3, 12, 50), ("b", 9, 13, 2 * DAY + 1), ("b", None, 1, 1), ("b", 1, 2, None), ("a", 1, 14, 200), ("a", -5, 15, -1)]
    parents = [(1, 10, 100), (1, 10, 100), (2, None, None), (3, 60, None), (None, 1, 2), (4, 1, 2)]
    want = [("a", "1969-12-31", -5, 15, "missing"), ("a", "1970-01-01", 1, 10, "early"), ("a", "1970-01-01", 1, 14, "gone"), ("b", "1970-01-01", 3, 12, "early"), ("b", "1970-01-03", 9, 13, "missing")]
    assert run(spark, refs, parents) == want
    assert run(spark, refs, parents, limit=0) == want  # the shuffled join gives the same


def test_conflicting_parents(spark):
    parents = [(1, 10, 100), (1, 50, None), (2, 10, 20), (2, 30, 40)]
    assert run(spark, [("a", 1, 1, 500), ("a", 1, 2, 9), ("a", 2, 3, 35), ("a", 2, 4, 41)], parents) == [("a", "1970-01-01", 1, 2, "early"), ("a", "1970-01-01", 2, 4, "gone")]


def test_runs_cross_blocks(spark):
    b = 1 << R.BLOCK_BITS
    p = spark.createDataFrame([(k,) for k in [b - 2, b - 1, b, b + 1, b + 5, 3 * b, -1]], "key bigint")
    assert rows(R.key_runs(p, "key"), "run_start", "run_end") == [(-1, -1), (b - 2, b - 1), (b, b + 1), (b + 5, b + 5), (3 * b, 3 * b)]
    keys = spark.createDataFrame([(k,) for k in (b - 3, b - 2, b + 2, b + 5, 3 * b - 1, 3 * b, -1, -2)], "k bigint")
    got = dict(rows(R.beyond_runs(keys, R.key_runs(p, "key")), "k", "missing"))
    assert got == {b - 3: True, b - 2: False, b + 2: True, b + 5: False, 3 * b - 1: True, 3 * b: False, -1: False, -2: True}


def test_filler_times(spark):
    top = 2**63 - 1
    got = R.orphans(spark.createDataFrame([("a", 1, 1, top, "z", 1), ("a", 2, 1, -top, "z", 1)], REFS), spark.createDataFrame([(1, 0, 5, "z")], PARENTS))
    assert sorted((r["key"], r["period"] is None, r["kind"]) for r in got.collect()) == [(1, True, "gone"), (2, True, "missing")]


def test_empty_sides(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    assert run(spark, [("a", 1, 1, 1)], []) == [("a", "1970-01-01", 1, 1, "missing")]
