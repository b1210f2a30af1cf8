import time
from collections import defaultdict

import numpy as np
import pytest

from tarnwheel.llm import packing as P

SCHEMA = "id bigint, text string, shard int, container string"


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in texts], SCHEMA)
    return [tuple(r) for r in P.pack(df, "id", "text", **kw).collect()]


def words(n):
    return " ".join(["tree"] * n)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_document_is_whole_and_no_container_overflows(spark, score):
    rng = np.random.default_rng(0)
    texts = [(i, words(int(n))) for i, n in enumerate(rng.integers(1, 90, 300))]
    out = run(spark, texts, capacity=100, max_docs=5, max_cost=6000, score=score, shard_docs=100)
    assert sorted(r[0] for r in out) == list(range(300)) and all(r[1] == 0 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r[4]].append(r[3])
    assert all(sum(x) <= 100 and len(x) <= 5 and (len(x) == 1 or sum(n * n for n in x) <= 6000) for x in by.values())


def test_little_room_is_unused(spark):
    rng = np.random.default_rng(1)
    size = rng.integers(1, 400, 3000)
    bins = P.best_fit(size, 2048, 256, 2048.0**2)
    used = np.bincount(bins, size)
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.98


def test_larger_than_a_container_empty_null_and_repeated(spark):
    out = run(spark, [(1, words(250)), (2, ""), (3, None), (4, words(10)), (4, words(10)), (None, words(3))], capacity=100)
    one = sorted((r[1], r[2], r[3]) for r in out if r[0] == 1)
    n = sum(x[2] for x in one)
    assert one == [(k, 100 * k, min(100, n - 100 * k)) for k in range(-(-n // 100))]
    full = [r[4] for r in out if r[0] == 1 and r[3] == 100]
    assert len(set(full)) == len(full) and all(sum(x[3] for x in out if x[4] == c) == 100 for c in full)
    assert [r[3] for r in out if r[0] in (2, 3)] == [0, 0] and len([r for r in out if r[0] == 4]) == 2 and len(out) == len(one) + 5


def test_very_long_text_and_empty_table(spark):
    out = run(spark, [(1, words(60_000))])
    assert sum(r[3] for r in out) >= 60_000 and max(r[3] for r in out) == 2048
    assert run(spark, []) == []


def test_fill(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 3)], "container bigint, n_tokens bigint")
    assert sorted(tuple(r) for r in P.fill(df).collect()) == [(1, 2, 11, 61), (2, 1, 3, 9)]


def slow(size, capacity, max_docs, max_cost, weights, score):
    """Best fit by looking at every container; of those with one room in tokens the one with the least (norm) or most (dot) attention cost left."""
    w = np.asarray(weights) / np.array([capacity, max_docs, max_cost])
    bins, open_ = [0] * len(size), []
    for i in np.argsort(-size, kind="stable"):
        d = np.array([size[i], 1.0, float(size[i]) ** 2])
        room = {}
        for k, r in enumerate(open_):
            if (r >= d).all():
                key = (r[2], r[1], k)
                if r[0] not in room or (key < room[r[0]] if score == "norm" else key > room[r[0]]):
                    room[r[0]] = key
        value = lambda r: (((np.array([r, room[r][1], room[r][0]]) - d) * w) ** 2).sum() if score == "norm" else -(np.array([r, room[r][1], room[r][0]]) * d * w * w).sum()  # noqa: B023, E731
        k = room[min(sorted(room), key=value)][2] if room else len(open_)
        if k == len(open_):
            open_.append(np.array([capacity, max_docs, max_cost], float))
        open_[k] -= d
        bins[i] = k
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("max_cost", [200.0**2, 200.0**2 / 4, 9_000.0])
def test_rooms_find_what_a_look_at_every_container_finds(score, max_cost):
    size = np.random.default_rng(3).integers(0, 120, 400)
    assert P.best_fit(size, 200, 9, max_cost, score=score).tolist() == slow(size, 200, 9, max_cost, P.WEIGHTS, score)


def test_work_grows_in_line_with_the_items():
    size = np.random.default_rng(5).integers(1, 400, 24_000)
    took = []
    for n in (3_000, 24_000):
        began = time.process_time()
        P.best_fit(size[:n], 2048, 256, 2048.0**2 / 4)
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0]
