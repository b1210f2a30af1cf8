"""Properties of the pieces that need no session."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwheel.operators import grid, intervals, solver, spatial, spikes

RUNS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(1, 12)), max_size=40)


@given(RUNS)
@settings(max_examples=150, deadline=None)
def test_united_bitmaps_hold_the_same_bits(runs):
    g, s, n = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    a, b, c = intervals.unite(g, s, s + n)
    bits = {(int(k), t) for k, x, m in runs for t in range(x, x + m)}
    assert {(int(k), t) for k, x, y in zip(a, b, c) for t in range(x, y)} == bits
    assert all(k != k2 or y < x2 for (k, _, y), (k2, x2, _) in zip(zip(a, b, c), list(zip(a, b, c))[1:]))
    again = intervals.decode(intervals.encode(a, b, c, 4))
    assert all((x == y).all() for x, y in zip(again, (a, b, c)))


def test_no_bitmaps():
    assert [len(x) for x in intervals.decode(pa.array([None, b""], pa.binary()))] == [0, 0, 0]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_cuts_grow_and_share_the_load(load, n):
    c = spatial.cuts(load, n)
    assert len(c) == n + 1 and c[0] == 0 and c[-1] == len(load) and c == sorted(c)
    total = sum(load)
    for k in range(1, n):
        assert sum(load[: c[k]]) >= total * k / n * (1 - 1e-6)
        assert c[k] == 0 or not total or sum(load[: c[k] - 1]) < total * k / n * (1 + 1e-6)


@given(st.integers(1, 60), st.integers(1, 12))
def test_bounds_differ_by_one_at_most(n, parts):
    b = solver.bounds(n, parts)
    sizes = [z - a for a, z in zip(b, b[1:])]
    assert b[-1] == n and len(sizes) == parts and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@given(st.integers(1, 40), st.floats(0, 0.3), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_levels_touch_only_their_neighbours(n, p, seed):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.random((n, n)) < p, 1)
    r, c = np.nonzero(m | m.T | np.eye(n, dtype=bool))
    level = solver.levels_of(n, r, c)
    assert (level >= 0).all() and (np.abs(level[r] - level[c]) <= 1).all() and set(level) == set(range(level.max() + 1))


@given(st.integers(8, 200), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_stuck_runs_are_whole_and_long(n, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 10**6, n)
    a = int(rng.integers(0, n - 7))
    v[a : a + 8] = v[a]
    hit = spikes.stuck(v)
    assert not hit.any() or (hit.sum() >= 8 and hit[a : a + 8].all())
    assert n < 30 or hit.any()


@given(st.integers(1, 12), st.integers(1, 20), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_factors_are_finite_whatever_is_seen(m, n, seed):
    rng = np.random.default_rng(seed)
    u, v = grid.als(rng.normal(size=(m, n)) * 100, rng.random((m, n)) < 0.3)
    assert np.isfinite(u).all() and np.isfinite(v).all()
