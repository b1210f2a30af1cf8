import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import solver as V
from tarnwheel.sources import formats as X
from tarnwheel.sources import ranges as G
from tarnwheel.sources.catalog import Catalog, FrozenError, provenance, stored
from tarnwheel.streaming import incremental as N

from .conftest import rows


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    db = c.create("base", role="design")
    df = spark.range(3)
    assert db.write("ids", df, provenance("v1")) and not db.write("ids", spark.range(9), provenance("v1"))
    with pytest.raises(ValueError):
        db.write("ids", df, provenance("v2"))
    db.write_temp("scratch", df)
    assert db.read("ids").count() == 3 and db.read("scratch").count() == 3
    with pytest.raises(KeyError):
        db.read("none")
    with pytest.raises(KeyError):
        db.remove("none")
    db.remove("none", missing_ok=True)
    db.set_var("n", 5)
    with pytest.raises(ValueError):
        db.set_var("n", 6)
    assert db.get_var("n") == 5 and db.get_var("m") is None
    db.freeze()
    assert db.frozen and db.names() == ["ids"]
    for act in (lambda: db.write("x", df), lambda: db.remove("ids"), lambda: db.set_var("k", 1)):
        with pytest.raises(FrozenError):
            act()
    again = c.create("base")
    assert again.name == "base.1" and c.list() == ["base", "base.1"]
    moved = c.migrate(db, Catalog(spark, f"file://{tmp_path}/other"))
    assert moved.frozen and moved.get_var("n") == 5 and moved.read("ids").count() == 3


def test_chain_search(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    a, b, d, e = (c.create(n, role=r) for n, r in (("a", "x"), ("b", "y"), ("d", "x"), ("e", "z")))
    e.after(d).after(b)
    d.after(a)
    b.after(a)
    assert [x.name for x in c.find(e, role="x")] == ["d", "a"]
    assert [x.name for x in c.find(e)] == ["d", "b", "a"] and [x.name for x in c.find(a, forward=True, role="z")] == ["e"]
    assert c.find(e, uid="nothing") == [] and c.edges().count() == 4


TWF = """(TIMING_WINDOWS
(HEADER (DELIMITERS "/[]") (TIME_SCALE 1.000E-12))
(WAVEFORM "pump" 8000 (POSEDGE 750) (NEGEDGE 4750))
(CAUSED_BY NULL
(PIN "heron/q7" 33:410 61:72 * * 35:415 64:70 * * C)
)
(CAUSED_BY "pump" RISE
(ODD "marsh" 6)
(NET CONSTANT "reed")
(NET "otter" 640:725 88:91 3100 3350 655:730 83:97 3120 3410 C)
(NET "short" 12:19 7:8)
(NET "flag" 1:3 2:2 * * 1:3 2:2 * * Q)
)
(CAUSED_BY "nobody" FALL
(NET "wide\\/bank" 17:29 6 41:58 2200 13:31 9:11 43:59
 2250 D)
)
)"""


def texts(spark, *t):
    return spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(t)], "file string, text string")


def test_timing_windows(spark):
    r = X.parse(texts(spark, TWF), "twf").cache()
    assert rows(X.waveforms(r), "name", "period", "negedge") == [("pump", 8.0, 4.75)]
    got = {x["name"]: x for x in X.entries(r).collect()}
    assert sorted(got) == ["heron/q7", "otter", "reed", "wide/bank"] and got["reed"]["constant"] and got["heron/q7"]["type"] == "PIN"
    assert got["otter"]["clock"] == "pump" and got["otter"]["rise_arrival_max"] == 0.725
    assert got["wide/bank"]["clock"] is None and got["wide/bank"]["missing_clock"] == "nobody" and got["wide/bank"]["rise_slew_max"] == 0.006
    assert rows(r.groupBy("kind").count().where("kind in ('bad', 'unknown')")) == [("bad", 2), ("unknown", 1)]


LIB = """/* note */ library (x) { lu_table_template (p) { variable_1 : a; index_1 ("0.1, 0.5"); }
 cell (INV) { area : 2.0; pin (A) { direction : input; capacitance : 1.5; } pin(Z) { direction: output; timing () { related_pin : "A"; cell_rise (p) { values ("1, 2"); } } odd_group () { z : 1; } } }
 cell (BUF) { area : 3.5; } // end
}"""
DEF = """VERSION 5.8 ;
DESIGN jetty ;
UNITS DISTANCE MICRONS 2000 ;
DIEAREA ( 0 0 ) ( 9000 7000 ) ;
COMPONENTS 2 ;
 - lamp INV + PLACED ( 1300 1303 ) N ;
 - rope W + UNPLACED ;
END COMPONENTS
SPECIALNETS 1 ;
 - GROUND ( lamp G ) + ROUTED M2 320 ( 640 1200 ) ( 640 3800 ) + RECT M3 ( 40 60 ) ( 940 460 ) + USE GROUND ;
END SPECIALNETS
NETS 1 ;
 - tide ( PIN IN3 ) ( lamp A ) + USE CLOCK + ROUTED M1 ( 1340 1520 ) VIA12 ( 1340 2680 ) NEW M2 ( 1340 2680 ) ( 2260 * ) ;
END NETS
END DESIGN"""
LEF = """VERSION 5.8 ;
# note
LAYER M1 TYPE ROUTING ; DIRECTION HORIZONTAL ; WIDTH 0.07 ; SPACING 0.1 ; SPACING 0.2 ; END M1
VIA v1 DEFAULT LAYER M1 ; RECT -0.2 -0.2 0.2 0.2 ; END v1
MACRO INV CLASS CORE ; SIZE 1.0 BY 1.5 ; PIN A DIRECTION INPUT ; USE SIGNAL ; PORT LAYER M1 ; RECT 0 0 0.2 0.2 ; END END A OBS LAYER M1 ; RECT 0.5 0.5 0.6 0.6 ; END END INV
MACRO BUF CLASS BLOCK ; SIZE 2 BY 2 ; END BUF
END LIBRARY"""


def test_liberty_lef_and_def(spark):
    lib = X.parse(texts(spark, LIB), "liberty").cache()
    assert rows(X.cells(lib), "name", "area") == [("BUF", 3.5), ("INV", 2.0)]
    t = X.tables(lib).first()
    assert (t["parent"], t["template"], list(t["values"])) == ("x/INV/Z/timing1", "p", [1.0, 2.0])
    assert lib.where("kind = 'unknown'").count() == 1
    lef = X.parse(texts(spark, LEF), "lef").cache()
    assert rows(X.macros(lef), "name", "width", "height") == [("BUF", 2000, 2000), ("INV", 1000, 1500)]
    assert rows(X.boxes(lef), "parent", "layer", "xh") == [("INV/A", "M1", 200)] and rows(X.boxes(lef, "obs"), "parent", "xl") == [("INV", 500)]
    d = X.parse(texts(spark, DEF), "def").cache()
    assert [tuple(r) for r in X.components(d).orderBy("name").select("name", "status", "x", "y").collect()] == [("lamp", "PLACED", 650, 652), ("rope", "UNPLACED", None, None)]
    assert rows(X.connections(d), "net", "instance", "pin") == [("GROUND", "lamp", "G"), ("tide", "PIN", "IN3"), ("tide", "lamp", "A")]
    assert [list(r["nums"]) for r in d.where("kind = 'wire' and parent = 'tide'").collect()] == [[670, 760, 670, 1340], [670, 1340, 1130, 1340]]


@pytest.mark.parametrize("form, text", [("twf", TWF), ("liberty", LIB), ("lef", LEF), ("def", DEF)])
def test_chunked_is_whole(spark, form, text):
    pick = lambda r: sorted(map(str, (x.asDict() for x in r.drop("chunk").collect())))
    whole, parts = X.parse(texts(spark, text), form), X.split_texts(texts(spark, text), form, 1).cache()
    assert parts.count() > 1 and pick(X.parse(parts, form)) == pick(whole)


@pytest.mark.parametrize("form", ["twf", "liberty", "lef", "def"])
@pytest.mark.parametrize("chunk", [300, 2_000, 1 << 20])
def test_byte_ranges_are_whole_files(spark, tmp_path, form, chunk):
    n = 60
    text = {
        "twf": '(TIMING_WINDOWS\n(HEADER (TIME_SCALE 1e-9))\n(WAVEFORM "k1" 4 (POSEDGE 0) (NEGEDGE 2))\n' + "".join(f'(CAUSED_BY "k{i % 2}" RISE\n(NET "n{i}" {i}:{i + 3} * * * * * * *)\n(NET "m{i}" 1:2)\n)\n' for i in range(n)) + ")\n",
        "liberty": 'library (mill) {\n lu_table_template (t) { index_1 ("0, 1"); }\n' + "".join(f' cell (c{i}) {{ area : {i}.5; pin (A) {{ direction : input; }} }}\n' for i in range(n)) + "}\n",
        "lef": "VERSION 5.8 ;\nLAYER M2\n TYPE ROUTING ;\n WIDTH 0.1 ;\nEND M2\n" + "".join(f"MACRO W{i}\n CLASS CORE ;\n SIZE {i}.0 BY 2.0 ;\nEND W{i}\n" for i in range(n)) + "END LIBRARY\n",
        "def": "VERSION 5.8 ;\nDESIGN quay ;\nUNITS DISTANCE MICRONS 1000 ;\nCOMPONENTS 60 ;\n" + "".join(f" - u{i} W{i} + PLACED ( {i} 7 ) N ;\n" for i in range(n)) + "END COMPONENTS\nNETS 60 ;\n" + "".join(f" - n{i} ( u{i} A )\n   ( u{i + 1} B ) + USE SIGNAL ;\n" for i in range(n)) + "END NETS\nEND DESIGN\n",
    }[form]
    paths = []
    for k in range(2):
        (tmp_path / f"f{k}").write_text(text if k else text.replace("n7", "other7"))
        paths.append(f"file://{tmp_path}/f{k}")
    pick = lambda r: sorted(map(str, (tuple(x.asDict().items()) for x in r.drop("chunk").collect())))
    whole = X.parse(spark.createDataFrame([(p, (tmp_path / p[-2:]).read_text()) for p in paths], "file string, text string"), form)
    plan = G.plan(spark, paths, form, chunk)
    assert pick(G.read_ranges(spark, paths, form, chunk)) == pick(whole)
    longest = plan.agg(F.max(F.col("stop") - F.col("start"))).first()[0]
    assert plan.count() > 20 and longest < 1300 if chunk == 300 else True


def test_a_table_function_parses_texts(spark):
    texts(spark, TWF, None).createOrReplaceTempView("made_texts")
    spark.udtf.register("parse_twf", X.parser("twf"))
    got = spark.sql("select t.file, p.kind, p.name from made_texts t, lateral parse_twf(t.text) p where p.kind = 'entry'")
    assert rows(got, "name") == [("heron/q7",), ("otter",), ("reed",), ("wide/bank",)]


def test_wrong_type_of_file(spark):
    with pytest.raises(ValueError, match="does not look like"):
        X.sniff(LEF, "liberty", "x.lef")
    with pytest.raises(Exception, match="does not look like"):
        X.parse(texts(spark, "nothing"), "def").count()


def test_read_from_disk(spark, tmp_path):
    (tmp_path / "a.lib").write_text(LIB)
    assert X.cells(G.read_ranges(spark, [f"file://{tmp_path}/a.lib"], "liberty", 10)).count() == 2


def test_blocks_and_bounds():
    assert V.factor(6) == (2, 3) and V.bounds(10, 2) == [0, 5, 10] and V.bounds(10, 3) == [0, 4, 7, 10]


def test_sparse_factor_against_dense():
    rng = np.random.default_rng(3)
    for n, p in ((1, 1.0), (30, 0.05), (60, 0.02), (80, 0.2)):
        m = np.triu(rng.random((n, n)) < p, 1) * -rng.random((n, n))
        m = m + m.T
        np.fill_diagonal(m, np.abs(m).sum(1) + 1)
        r, c = np.nonzero(m)
        b = rng.normal(size=n)
        assert np.allclose(V.Factor(n, r, c, m[r, c]).solve(b), np.linalg.solve(m, b))


@pytest.mark.parametrize("coarse", [False, True])
def test_schwarz_against_a_direct_solution(spark, coarse):
    n = 10
    a = V.poisson(spark, n)
    assert a.count() == 5 * n * n - 4 * n
    b = spark.range(n * n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    s = V.Schwarz(a, V.grid_blocks(spark, n, 4), 2, V.bilinear(spark, n, 3) if coarse else None)
    x, steps, rel = s.solve(b, 1e-6)
    got = np.array([r[1] for r in rows(x, "i", "v")])
    want = V.exact(a, b, n * n)
    assert rel < 1e-6 and np.abs(got - want).max() / np.abs(want).max() < 1e-4
    if not coarse:
        runs = s.march(b, lambda x, t: None if t > 1 else b, tol=1e-6)
        assert len(runs) == 2 and runs[1][1] <= 1


def test_streams(spark, tmp_path):
    src = tmp_path / "t.parquet"
    for k in range(3):
        spark.createDataFrame([(1, k, 10 * k), (2, 5, k), (1, k, 10 * k)], "k bigint, t bigint, v bigint").coalesce(1).write.mode("append").parquet(str(src))
    s = N.stream(spark, str(tmp_path), "t", max_files=1)
    assert N.drained(N.append_once(s, ["k", "t"]).select("k", "t")).count() == 4
    up = N.Upserts(spark, s.schema, ["k"], ["t", "v"])
    N.drain(s, up)
    assert rows(up.table(), "k", "t", "v") == [(1, 2, 20), (2, 5, 2)]
    keep = N.Upserts(spark, "k bigint, last_s bigint, score double", ["k"], ["last_s", "score"])
    N.drain(N.decayed_stream(N.stream(spark, str(tmp_path), "t"), "k", "t", "v", 0.5), keep, "update")
    assert {r["k"]: r["score"] for r in keep.table().collect()}[1] == pytest.approx(2 * 10 * 0.5 + 2 * 20)


def test_cursors_follow_each_key(spark):
    c = N.Cursors("k", "t")
    assert c.take(spark.createDataFrame([(1, 5000), (2, 800)], "k int, t int")).count() == 2
    assert rows(c.take(spark.createDataFrame([(1, 5000), (2, 900), (3, 1)], "k int, t int")), "k", "t") == [(2, 900), (3, 1)]


def test_throttle(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 100, 199, 200, 350, 401)], "k int, t bigint")
    assert [r[1] for r in rows(N.throttled(df, "k", "t", 200), "k", "t")] == [0, 200, 401]


def test_overlapping_solves_use_their_ghosts_and_give_all_unknowns(spark, monkeypatch):
    from tarnwheel.plans import registry

    query = registry.queries()["sv06_overlapping_solves"]
    want = np.linalg.solve(dense(10), np.ones(100))
    assert np.allclose([r[1] for r in rows(query(spark, ""), "i", "v")], want, atol=1e-6)
    exact = V.exact
    monkeypatch.setattr(V, "exact", lambda a, b, n: 0 * exact(a, b, n))  # told nothing of the outside, no block solves the whole
    assert not np.allclose([r[1] for r in rows(query(spark, ""), "i", "v")], want, atol=1e-2)


def dense(n):
    line = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    return np.kron(line, np.eye(n)) + np.kron(np.eye(n), line)


def test_a_block_too_large_for_a_factor_is_solved_by_gradients(monkeypatch):
    m = dense(12)
    r, c = np.nonzero(m)
    b = np.random.default_rng(1).normal(size=144)
    monkeypatch.setattr(V, "MAX_FACTOR", 100)
    f = V.Factor(144, r, c, m[r, c])
    assert f.entries is not None and np.allclose(f.solve(b), np.linalg.solve(m, b), atol=1e-10) and not f.solve(0 * b).any()


def test_without_convergence_there_is_no_result(spark):
    a, b = V.poisson(spark, 8), spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    s = V.Schwarz(a, V.grid_blocks(spark, 8, 2), 1)
    with pytest.raises(RuntimeError, match="no convergence in 2 steps"):
        s.solve(b, 1e-12, max_steps=2)
    start = s.solve(b, 1e-9)[0]
    x, steps, rel = s.solve(b, 1e-8, min_steps=0, start=start)
    assert steps == 0 and rel <= 1e-8 and np.allclose([r[1] for r in rows(x, "i", "v")], np.linalg.solve(dense(8), np.ones(64)), atol=1e-6)


def test_the_coarse_matrix_is_the_triple_product(spark):
    a, p = V.poisson(spark, 12), V.bilinear(spark, 12, 4)
    s = V.Schwarz(a, V.grid_blocks(spark, 12, 4), 1, p)
    want = np.zeros((16, 16))
    for i, j, v in rows(V.product(V.product(V.transposed(p), a), p), "i", "j", "v"):
        want[i, j] = v
    assert np.allclose(s.ac, want)


def test_factors_are_not_in_the_messages(spark):
    s = V.Schwarz(V.poisson(spark, 16), V.grid_blocks(spark, 16, 4), 2)
    sent = s._next(s._start(None), s._right_hand_side(spark.range(256).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))[0])
    assert sent.agg(F.sum(F.length("vals"))).first()[0] < 8 * 256 * 4


def test_blocks_that_grow_too_little_are_widened_twice(spark):
    a = V.poisson(spark, 8)
    b = spark.range(64).select(F.col("id").alias("i"), F.when(F.col("id") < 56, 0).otherwise(1).alias("sd"))  # seven rows and one
    got = rows(V.widened(a, b, 1, 0.5), "sd", "i", "own")
    want = [(0, i, i < 56) for i in range(64)] + [(1, i, i >= 56) for i in range(48, 64)]
    assert got == want  # the large block grew by a seventh and has no more to take, the small one doubled
    c = b.withColumn("sd", F.when(F.col("i") < 32, 0).otherwise(1))
    assert rows(V.widened(a, c, 1, 0.5), "sd", "i") == rows(V.widened(a, c, 2), "sd", "i") != rows(V.widened(a, c, 1), "sd", "i")


def test_upserts_go_on_after_a_restart_and_pass_over_a_batch_that_comes_again(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/up", "k bigint, t bigint, v string"
    rows_of = lambda *x: spark.createDataFrame(x, schema)
    new = lambda: N.Upserts(spark, schema, ["k"], ["t"], folder)
    new()(rows_of((1, 1, "a"), (2, 5, "b"), (2, 4, "x")), 0)
    new()(rows_of((1, 3, "c"), (3, 1, "d")), 1)
    want = [(1, 3, "c"), (2, 5, "b"), (3, 1, "d")]
    assert rows(new().table()) == want
    new()(rows_of((1, 9, "again")), 1)  # batch 1 comes again
    assert rows(new().table()) == want
    new()(rows_of().limit(0), 2)
    assert rows(new().table()) == want

    class Broken(N.Upserts):
        def _state(self):
            last, at = super()._state()
            self.files.create = lambda p, text: 1 / 0
            return last, at

    with pytest.raises(ZeroDivisionError):
        Broken(spark, schema, ["k"], ["t"], folder)(rows_of((2, 99, "lost")), 3)
    assert rows(new().table()) == want
    new()(rows_of((2, 99, "kept")), 3)
    assert rows(new().table()) == [(1, 3, "c"), (2, 99, "kept"), (3, 1, "d")]


def test_upserts_touch_only_the_buckets_of_their_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/up"
    up = N.Upserts(spark, "k bigint, t bigint", ["k"], ["t"], folder)
    up(spark.range(500).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("t")), 0)
    up(spark.createDataFrame([(7, 2)], "k bigint, t bigint"), 1)
    _, at = up._state()
    assert len(set(at.values())) == 2 and len(at) == up.BUCKETS and sum(v.startswith("000000000001") for v in at.values()) == 1
    assert up.table().agg(F.count("k"), F.sum("t")).first() == (500, 501)


def test_two_writers_at_once(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    a = c.create("d")
    b = c.open("d")

    class Slow:  # the other writer comes in while this one writes
        def __init__(self, df, act):
            self.df, self.act = df, act

        @property
        def write(self):
            self.act()
            return self.df.write

    assert not a.write("x", Slow(spark.range(3), lambda: b.write("x", spark.range(5), "v")), "v")
    assert a.read("x").count() == 5
    assert a.write("y", Slow(spark.range(3), lambda: b.write("z", spark.range(2))), "v") and a.names() == ["x", "y", "z"]
    with pytest.raises(ValueError):
        a.write("w", Slow(spark.range(3), lambda: b.write("w", spark.range(5), "other")), "v")
    with pytest.raises(FrozenError):
        a.write("late", Slow(spark.range(3), b.freeze), "v")
    assert b.names() == ["w", "x", "y", "z"] and b.frozen
    with pytest.raises(ValueError):
        c.create("e").set_var("n", 1) or c.open("e").set_var("n", 2)


def test_what_is_stored_is_made_once_for_each_state_of_its_files(spark, tmp_path):
    src, made = f"file://{tmp_path}/t", []
    make = lambda: made.append(1) or spark.read.parquet(src).where("id > 1")
    spark.range(5).write.parquet(src)
    assert [stored(spark, "x", [src], make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(9).write.mode("append").parquet(src)
    assert stored(spark, "x", [src], make).count() == 10 and len(made) == 2
