import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import merge as J
from tarnwheel.operators import scheduling as W
from tarnwheel.operators import solver as V
from tarnwheel.plans.flows import Flows
from tarnwheel.sources.api import Api, NotReady
from tarnwheel.sources.catalog import Catalog
from tarnwheel.streaming import incremental as N

from .conftest import rows


def test_worker_choice(spark):
    tasks = [(1, ["a"], False), (2, ["a", "b"], False), (3, ["a", "z"], True), (4, ["a", "z"], False), (5, ["z"], True), (6, [], False), (7, None, False), (8, ["a", "z"], True), (9, ["z"], True)]
    workers = [(10, ["b"], 1), (11, ["a"], 2), (12, ["a", "b"], 3), (13, [], 0)]
    local = [(3, 12, 50), (3, 11, 20), (3, 10, 900), (5, 10, 7), (5, 12, 7), (8, 10, 5), (9, 13, 0)]
    t = spark.createDataFrame(tasks, "task int, needs array<string>, may_degrade boolean")
    w = spark.createDataFrame(workers, "worker int, has array<string>, idle_order int")
    got = {r["task"]: (r["worker"], r["how"]) for r in W.choose_workers(t, w, spark.createDataFrame(local, "task int, worker int, bytes bigint")).collect()}
    assert got == {1: (11, "full"), 2: (12, "full"), 3: (12, "local"), 4: (None, "wait"), 5: (10, "local"), 6: (13, "full"), 7: (13, "full"), 8: (11, "degraded"), 9: (13, "degraded")}
    none = W.choose_workers(t, w.limit(0), spark.createDataFrame([], "task int, worker int, bytes bigint"))
    assert {r["how"] for r in none.collect()} == {"wait"}


def test_ids_kept_and_renumbered(spark):
    names = [("a", 5, 1), ("b", 5, 2), ("c", None, 3), ("d", 9, 4), ("d", 2, 6), ("e", 9, 4)]
    ids = J.renumbered(spark.createDataFrame(names, "n string, g bigint, o int"), "n", "g", ["o"])
    assert rows(ids, "n", "id", "kept") == [("a", 5, True), ("b", 10, False), ("c", 11, False), ("d", 9, True), ("e", 12, False)]
    refs = spark.createDataFrame([(1, "b"), (2, "x"), (3, None)], "k int, n string")
    assert {r["k"]: r["n"] for r in J.rewritten(refs, "n", ids, "n").collect()} == {1: 10, 2: None, 3: None}
    assert J.renumbered(spark.createDataFrame([], "n string, g bigint, o int"), "n", "g", ["o"]).count() == 0


def test_api_and_server(spark):
    api = Api()
    api.route("/rows/{k}")(lambda k, limit="9": spark.range(int(k)).limit(int(limit)))
    api.route("/value")(lambda: {"a": 1})

    @api.route("/later")
    def later():
        raise NotReady("soon")

    assert api.get("/rows/3?limit=2") == (200, '[{"id": 0}, {"id": 1}]') and api.get("/value/") == (200, '{"a": 1}')
    assert api.get("/later")[0] == 503 and api.get("/rows/x")[0] == 500 and api.get("/")[0] == 404
    server = api.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        with urllib.request.urlopen(f"{url}/value") as r:
            assert json.loads(r.read()) == {"a": 1}
        with pytest.raises(urllib.error.HTTPError, match="503"):
            urllib.request.urlopen(f"{url}/later")
    finally:
        server.shutdown()


def test_arrivals_come_and_go(spark):
    inputs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "task bigint, object string")
    a = N.Arrivals(spark, inputs)
    batch = lambda *x: spark.createDataFrame(x, "object string, at bigint, present boolean")
    look = lambda: {r["task"]: (r["batch"], r["n_missing"], r["ready"]) for r in a.table().collect()}
    a(batch(("a", 1, True)), 0)
    assert look() == {1: (0, 1, False), 2: (0, 1, False), 3: (0, 1, False)}
    a(batch(("b", 2, True)), 1)
    assert look() == {1: (1, 0, True), 2: (1, 0, True), 3: (0, 1, False)}
    a(batch(("a", 3, False), ("a", 2, True)), 2)
    assert look() == {1: (2, 1, False), 2: (1, 0, True), 3: (0, 1, False)}
    a(batch(("c", 3, True)), 2)  # comes again: nothing changes
    assert look()[3] == (0, 1, False)


def test_waiting_confirms_three_times(spark):
    w = N.Waiting(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"))
    seen = lambda **k: spark.createDataFrame(list(k.items()), "name string, verdict string")
    assert w.look(seen(a="wait", b="never", c="never")) == 3
    assert w.look(seen(a="available", b="never", c="wait")) == 2
    assert w.look(seen(a="never", b="never", c="never")) == 1
    assert w.look(seen(c="never")) == 1 and w.look(seen()) == 0
    assert rows(w.state, "name", "verdict") == [("a", "available"), ("b", "never"), ("c", "never")]
    looks = iter([seen(a="wait"), seen(a="available")])
    assert rows(N.Waiting(spark.createDataFrame([("a",)], "name string")).until(lambda: next(looks), 0.0)) == [("a", "available")]
    with pytest.raises(TimeoutError):
        N.Waiting(spark.createDataFrame([("a",)], "name string")).until(lambda: seen(a="wait"), 0.0, 2)


def test_sink_ignores_what_is_there(spark):
    first = N.MetricsSink(spark).ignore("w", "k int, v string", ["k"])
    first(spark.createDataFrame([(1, "b"), (1, "a"), (2, "x")], "k int, v string"), 0)
    first(spark.createDataFrame([(2, "a"), (3, "y")], "k int, v string"), 1)
    assert rows(first.table(), "k", "v") == [(1, "a"), (2, "x"), (3, "y")]


def test_throttle_over_runs_is_throttle_over_all(spark):
    t = np.cumsum(np.random.default_rng(3).integers(1, 300, 400)).tolist()
    keep, last = [], None
    for x in t:
        if last is None or x - last >= 200:
            keep.append(x)
            last = x
    df = spark.createDataFrame([(1, x) for x in t] + [(None, 5), (2, None), (2, 7), (2, 7)], "k int, t bigint")
    assert rows(N.throttled(df, "k", "t", 200), "k", "t") == [*((1, x) for x in keep), (2, 7)]


def test_throttle_runs_no_python_group_for_each_run(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    def refused(*_):
        raise AssertionError("a Python group for each run")

    for way in ("applyInPandas", "applyInArrow"):
        monkeypatch.setattr(GroupedData, way, refused)
    day = 86_400_000  # lone rows, pairs, and a run of closer rows over the end of a day
    t = [*range(0, 40_000, 400), *range(50_000, 60_000, 500), *range(50_100, 60_100, 500), *range(day - 1_000, day + 1_000, 90)]
    keep = {k: [] for k in (1, 2)}
    for k in keep:
        for x in sorted(t):
            if not keep[k] or x - keep[k][-1] >= 200:
                keep[k].append(x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # runs go on from batch to batch
    try:
        got = rows(N.throttled(spark.createDataFrame([(k, x) for k in keep for x in t], "k int, t bigint"), "k", "t", 200), "k", "t")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k, x) for k in keep for x in keep[k]]


def test_resumed_flows_and_provenance(spark, tmp_path):
    db = Catalog(spark, f"file://{tmp_path}/c").create("r")
    f, runs = Flows(), []
    f.flow("a", ("x",))(lambda x: runs.append("a") or x.where("id > 1"))
    f.flow("b", ("a",))(lambda a: runs.append("b") or a.where("id > 2"))
    given = {"x": spark.range(6)}
    assert f.resume("a", db, given, "v1").count() == 4 and f.resume("b", db, given, "v1").count() == 3 and f.resume("b", db, given, "v1").count() == 3
    assert runs == ["a", "b"]
    with pytest.raises(ValueError, match="something else"):
        f.resume("b", db, given, "v2")


@pytest.mark.parametrize("form", ["matrix", "indptr", "row"])
def test_stored_matrices(spark, tmp_path, form):
    m = np.array([[2.0, 0, -1], [0, 3, 0], [0, 0, 4]])
    i, j = np.nonzero(m)
    arrays = {"matrix": {"matrix": m}, "row": {"row": i, "col": j, "data": m[i, j]}, "indptr": {"indptr": np.r_[0, np.cumsum((m != 0).sum(1))], "indices": j, "data": m[i, j]}}[form]
    np.savez(tmp_path / "m.npz", **arrays)
    assert rows(V.stored_matrix(spark, f"file://{tmp_path}/m.npz"), "i", "j", "v") == [(0, 0, 2.0), (0, 2, -1.0), (1, 1, 3.0), (2, 2, 4.0)]
    with pytest.raises(ValueError):
        V.matrix_of(spark, {"x": m})


def test_paced_batches(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    seen = []
    n = N.paced(N.stream(spark, str(tmp_path), "t", max_files=1), lambda b, k: seen.append((k, b.agg(F.count("id")).first()[0])), "100 milliseconds")
    assert n == 3 and sum(c for _, c in seen) == 40 and [k for k, _ in seen] == [0, 1, 2]
