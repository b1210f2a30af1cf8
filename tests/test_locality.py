from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
from tarnwheel.operators import locality as LB

from .conftest import rows


def _tables(seed=5):
    """(reads, holders): one object that nearly everybody reads and holds, some that few do, some that nobody holds; nulls, zeros, negative sizes."""
    g = np.random.default_rng(seed)
    reads = {(t, "hot") for t in range(40) if t % 9} | {(int(t), f"o{o}") for t, o in g.integers(0, 40, (60, 2))} | {(None, "hot"), (None, "o3"), (3, None)}
    held = {("hot", w): int(g.integers(-3, 9)) for w in range(30)} | {(f"o{o}", int(w)): int(b) for o, w, b in zip(g.integers(0, 30, 90), g.integers(0, 33, 90), g.integers(-3, 9, 90))}
    return sorted(reads, key=str), [(o, w, b) for (o, w), b in (held | {("hot", None): 4, ("o3", None): 2, (None, 1): 5}).items()]


def _summed(reads, held):
    s = defaultdict(lambda: [0, 0])
    for t, o in reads:
        for p, w, b in held:
            if o == p is not None:
                s[t, w][0] += b
                s[t, w][1] += 1
    return {k: tuple(v) for k, v in s.items()}


@pytest.mark.parametrize("pairs", [40, 400, LB.PAIRS])
def test_local_bytes_in_any_cells(spark, pairs):
    reads, held = _tables()
    got = LB.local_bytes(spark.createDataFrame(reads, "task int, object string"), spark.createDataFrame(held, "object string, worker int, bytes bigint"), pairs).collect()
    want = _summed(reads, held)
    assert len(got) == len(want) and {(r["task"], r["worker"]): (r["bytes"], r["n_objects"]) for r in got} == want


def test_local_bytes_in_small_blocks_and_tables_of_few_pairs(monkeypatch):
    import pyarrow as pa

    reads, held = _tables(6)
    names = {o: i for i, o in enumerate(sorted({o for o, _, _ in held if o} | {o for _, o in reads if o}))}
    q = [(t, names[o]) for t, o in reads if o]
    h = [(names[o], w, b) for o, w, b in held if o]
    h += [(names["o3"], 100 + w, 1) for w in range(900)]  # workers that few tasks meet
    for most in (1, 60, LB.PAIRS_AT_ONCE):
        monkeypatch.setattr(LB, "PAIRS_AT_ONCE", most)
        tasks, workers, blocks = LB.sums(pa.table({"task": [t for t, _ in q], "unit": [u for _, u in q]}), pa.table({"of": [u for u, _, _ in h], "worker": [w for _, w, _ in h], "bytes": [b for _, _, b in h]}))
        got = [(tasks[t].as_py(), workers[w].as_py(), b, n) for block in blocks for t, w, b, n in zip(*(x.tolist() for x in block))]
        assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2:] for x in got} == _summed(q, h)


def test_sums_beyond_64_bits_are_not_wrapped(spark):
    big = 2**62
    reads = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "task int, object string")
    held = lambda b: spark.createDataFrame([("a", 7, big), ("b", 7, b)], "object string, worker int, bytes bigint")
    assert rows(LB.local_bytes(reads, held(big - 1)), "task", "bytes") == [(1, 2 * big - 1), (2, big)]
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        LB.local_bytes(reads, held(big)).collect()


def test_pairs_of_tasks_and_workers_are_not_shuffled(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 300
    io = [(i, i, i % 50, "w", "hot", 10) for i in range(n)] + [(n + i, i, 0, "r", "hot", None) for i in range(n)]
    pq.write_table(pa.table(dict(zip(("id", "task_id", "worker_id", "direction", "object_name", "bytes"), map(list, zip(*io))))), tmp_path / "object_io.parquet")
    df = __spark_entry__.queries()["jn25_locality"](spark, str(tmp_path))
    assert df.count() == n * 50
    plan = df._jdf.queryExecution().sparkPlan().toString()
    made = next(i for i, line in enumerate(plan.split("\n")) if "MapInArrow" in line or "Join" in line)
    assert not any("Aggregate" in line for line in plan.split("\n")[:made])


@pytest.mark.parametrize("pairs", [40, LB.PAIRS])
def test_most_local_of_those_that_fit(spark, pairs):
    reads, held = _tables(7)
    needs = {t: ["a"] if t % 3 else ["b"] for t in range(40) if t % 5}
    fits = lambda n, w: w is not None and w % 2 == (n == ["a"])
    want = {}
    for (t, w), (b, _) in _summed(reads, held).items():
        if b > 0 and t in needs and fits(needs[t], w):
            want[t] = min(want.get(t, (0, 0)), (-b, w))
    got = LB.most_local(
        spark.createDataFrame(list(needs.items()), "task int, needs array<string>"),
        lambda df: df.where("worker % 2 = if(needs[0] = 'a', 1, 0)"),
        spark.createDataFrame(reads, "task int, object string"),
        spark.createDataFrame(held, "object string, worker int, bytes bigint"),
        pairs,
    )
    assert {r["task"]: tuple(r["near"]) for r in got.collect()} == want


def test_worker_choice_adds_up_only_what_it_needs(spark, monkeypatch):
    """The pairs of all tasks and workers are not made to choose one worker for each of some tasks."""
    from tarnwheel.operators import scheduling as W

    reads, held = _tables(8)
    reads, held = [r for r in reads if r[0] is not None], [h for h in held if h[1] is not None]
    tasks = spark.createDataFrame([(t, ["a", "z"][: 1 + t % 2], t % 3 > 0) for t in range(45)], "task int, needs array<string>, may_degrade boolean")
    workers = spark.createDataFrame([(w, ["a"] if w % 4 else [], 40 - w) for w in range(32)], "worker int, has array<string>, idle_order int")
    r, h = spark.createDataFrame(reads, "task int, object string"), spark.createDataFrame(held, "object string, worker int, bytes bigint")
    want = rows(W.choose_workers(tasks, workers, LB.local_bytes(r, h).drop("n_objects")), "task", "worker", "how")
    met = []
    in_cells = LB.in_cells
    monkeypatch.setattr(LB, "in_cells", lambda q, *rest: met.append({x["task"] for x in q.collect()}) or in_cells(q, *rest))
    assert rows(W.choose_workers(tasks, workers, reads=r, holders=h), "task", "worker", "how") == want
    assert len(met) == 1 and all(t % 2 and t % 3 for t in met[0])
    assert {x[2] for x in want} == {"full", "wait", "local", "degraded"}
