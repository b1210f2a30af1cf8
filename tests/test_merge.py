import pytest
from pyspark.sql import functions as F

from tarnwheel.functions import scalar as S
from tarnwheel.functions import schema as C
from tarnwheel.operators import lookup as L
from tarnwheel.operators import mapreduce as M
from tarnwheel.operators import merge as J
from tarnwheel.plans.flows import Flows

from .conftest import rows


def test_linked_and_differences(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert rows(J.linked(a, b, "k")) == [(1, "left"), (2, "both"), (3, "right")]
    x = spark.createDataFrame([("g", "a"), ("g", "b")], "g string, i string")
    y = spark.createDataFrame([("g", "b"), ("h", "c")], "g string, i string")
    assert rows(J.set_differences(x, y, "g", "i")) == [("g", "a", "left"), ("h", "c", "right")]


def test_fallback_rows(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, None)], "k int, v string")
    got = {r["k"]: (r["v"], r["fallback"]) for r in J.with_fallback(a, b, "k", {"v": F.lit("none")}).collect()}
    assert got == {1: (None, False), 2: ("none", True), None: ("none", True)}


def test_range_union_and_conflicts(spark):
    df = spark.createDataFrame([("n", 1, 5.0, 9.0, "c1", True), ("n", 2, 3.0, None, "c2", None), ("m", 3, None, None, None, None)], "k string, o int, lo double, hi double, c string, f boolean")
    got = {r["k"]: tuple(r[c] for c in ("lo", "hi", "f", "c", "multi_source")) for r in J.range_union(df, ["k"], ["lo"], ["hi"], ["f"], "c", ["o"]).collect()}
    assert got == {"n": (3.0, 9.0, True, "c1", True), "m": (None, None, False, None, False)}
    f = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 2, 4)], "k string, file int, o int")
    assert rows(J.first_by_file(f, ["k"], "file", ["o"]), "k", "o", "n_conflicts") == [("a", 1, 1), ("b", 4, 0)]
    p = spark.createDataFrame([("c", 1, 1, 10.0), ("c", 0, 2, 12.0), ("c", 1, 3, 12.0)], "k string, pr int, o int, v double")
    assert rows(J.priority_merge(p, "k", "pr", ["o"], ["v"])) == [("c", 12.0, 1)]


def test_first_of_counts_what_it_drops(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 1, "w")], "k string, o int, v string")
    got = {r["k"]: (r["v"], r["n_dropped"]) for r in J.first_of(df, ["k"], ["o"]).collect()}
    assert got == {"a": ("y", 2), None: ("w", 0)}


@pytest.mark.parametrize("kind", ["summary", "full"])
def test_mapreduce_keeps_the_order(spark, kind):
    mr = M.MapReduce(spark).set_partitioner(lambda d: [[x] for x in d]).set_processor(lambda p: [v * 2 for v in p]).set_merger(lambda a, b: a + b, kind)
    assert mr.run(list(range(20))).get() == [2 * i for i in range(20)]


def test_mapreduce_sum_finalizer_and_edges(spark):
    mr = M.MapReduce(spark).set_partitioner(lambda d: [d[i::3] for i in range(3)]).set_processor(sum).set_merger(lambda a, b: a + b)
    assert mr.run(list(range(1, 11))).get() == 55
    assert mr.set_finalizer(lambda v: {"total": v}).run([1]).get() == {"total": 1}
    assert M.MapReduce(spark).set_partitioner(lambda d: []).set_processor(sum).set_merger(max).run([1]).get() is None
    with pytest.raises(ValueError):
        M.MapReduce(spark).set_processor(sum).run([1])


def test_mapreduce_over_datasets_keeps_the_order_of_batches_and_runs_once(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    calls = spark.sparkContext.accumulator(0)

    def ids(part):
        calls.add(1)
        return [r["id"] for r in part]

    try:
        frames = [spark.range(0, 20, 1, 2), spark.range(100, 107, 1, 1), spark.range(0), spark.range(200, 201, 1, 1)]
        for kind in ("summary", "full"):
            calls.value = 0
            got = M.MapReduce(spark).set_pre_partitioned(*frames).set_processor(ids).set_merger(lambda a, b: a + b, kind).run().get()
            assert got == [*range(20), *range(100, 107), 200]
            assert calls.value == 4 + 4 + 3 + 1
        assert M.MapReduce(spark).set_pre_partitioned(spark.range(0)).set_processor(ids).set_merger(lambda a, b: a + b).run().get() is None
        assert M.MapReduce(spark).set_pre_partitioned(spark.range(1)).set_processor(ids).set_merger(lambda a, b: a + b).run().get() == [0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_words(spark):
    df = spark.createDataFrame([("oar rope oar  mast",), (None,), ("Mast keel mast mast",), ("",), (" keel oar ",)], "t string")
    assert rows(M.word_counts(df, "t")) == [("keel", 2), ("mast", 4), ("oar", 3), ("rope", 1)]


@pytest.mark.parametrize("x, y, want", [(3, 2, 7), (8, 2, 12), (5, 6, 13), (4, 2, 5), (3, 3, 7.25), (4, 4, 7.75), (6.5, 5, 12), (1, 70, 8), (60, -1, 12)])
def test_interpolation_in_two_dimensions(spark, x, y, want):
    arr = lambda *v: F.array(*(F.lit(float(a)) for a in v))
    v = L.interpolate([arr(3, 5, 8), arr(2, 6)], arr(7, 8, 3, 13, 12, 14), [F.lit(x), F.lit(y)])
    assert abs(spark.range(1).select(v).first()[0] - want) < 1e-12


def test_interpolation_in_one_and_three_dimensions(spark):
    arr = lambda *v: F.array(*(F.lit(float(a)) for a in v))
    cube = arr(*(4 * a + 2 * b + c for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    got = spark.range(1).select(
        L.interpolate([arr(0, 2)], arr(4, 8), [F.lit(0.5)]), L.interpolate([arr(7)], arr(42), [F.lit(-3)]), L.interpolate([arr(0, 1)] * 3, cube, [F.lit(0.5)] * 3),
        L.interpolate([arr(0, 1)] * 3, cube, [F.lit(0.25), F.lit(0), F.lit(0)]), L.interpolate([arr(0, 2)], arr(4, 8, 9), [F.lit(1)]),
    ).first()
    assert tuple(got) == (5.0, 42.0, 3.5, 1.0, None)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.floor_div(F.lit(-7).cast("bigint"), 2)) == -4 and one(S.floor_div(F.lit(7).cast("bigint"), 2)) == 3
    assert one(S.to_units(F.lit(-2.5), 1.0)) == -3
    assert one(S.strip_prefix(F.lit("a/b/c"), ["a"])) == "b/c" and one(S.strip_prefix(F.lit("a"), ["a"])) is None and one(S.strip_prefix(F.lit("ab/c"), ["a"])) is None
    assert one(S.fnv1a(F.lit("a"), 1 << 32)) == 0xE40C292C
    assert one(S.grid_spec(F.lit("3x4"))).asDict() == {"x": 3, "y": 4} and one(S.grid_spec(F.lit("0x4"))) is None and one(S.grid_spec(F.lit("ax4"))) is None
    assert one(S.number_range(F.lit("1:2"))).asDict() == {"min": 1.0, "max": 2.0, "present": True} and one(S.number_range(F.lit("1:2:3"))) is None
    assert [one(S.size_text(F.lit(v))) for v in (4096, 480 << 20, 3 << 29)] == ["4KB", "480MB", "1.5GB"]
    assert one(S.domain(F.lit("a::b::c"))) == "a" and one(S.last_segment(F.lit("x/y/"))) == ""
    assert one(S.unescaped(F.lit(r"esc\/net"))) == "esc/net"


def test_parameter_rules():
    r = C.dict_of({"n": C.of(int, test=lambda v: v > 0, needs="above 0")}, {"names": C.list_of(C.of(str), 1), "any": C.any_of(C.of(int), C.of(str))})
    assert r.check({"n": 1, "names": ["a"], "any": "x"}) == []
    assert r.check({"n": 0, "names": [1], "odd": 2, "any": 1.5}) == ["odd: unknown", "n: above 0", "names[0]: str is needed, not int", "any: int is needed, not float | any: str is needed, not float"]
    with pytest.raises(ValueError, match="n: missing"):
        r({})


def test_flows_run_in_order_and_reject_cycles(spark):
    f = Flows()
    f.flow("a")(lambda: spark.range(3))
    f.flow("b", ("a",))(lambda a: a.where("id > 0"))
    f.flow("c", ("d",))(lambda d: d)
    f.flow("d", ("c",))(lambda c: c)
    assert f.run("b").count() == 2 and f.order("b") == ["a", "b"]
    with pytest.raises(ValueError, match="itself"):
        f.run("c")
    with pytest.raises(ValueError, match="twice"):
        f.flow("a")(lambda: None)
