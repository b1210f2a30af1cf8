import numpy as np
import pytest

from tarnwheel.llm import quantiles as Q

QS = (0.01, 0.25, 0.5, 0.9, 0.95, 0.99)


def sketch(*values, signs=None):
    c = np.zeros(Q.SIZE, np.int64)
    for v, s in zip(values, signs or [1] * len(values)):
        Q.add(c, v, np.full(len(v), s))
    return c


def rank_error(c, v):
    s = np.sort(Q.encode(v))  # values with one code are ties
    worst = 0.0
    for q in QS:
        x = Q.encode(np.array([Q.quantile(c, q)]))[0]
        lo, hi = np.searchsorted(s, x, "left") / len(s), np.searchsorted(s, x, "right") / len(s)
        worst = max(worst, 0.0 if lo <= q <= hi else min(abs(lo - q), abs(hi - q)))
    return worst


SHAPES = {
    "lognormal": lambda r, n: r.lognormal(8, 2, n), "few": lambda r, n: r.integers(0, 60, n) * 977, "middling": lambda r, n: r.integers(0, 400, n) ** 2 * 31,
    "offset": lambda r, n: r.integers(10**7, 10**7 + 10**5, n), "wide": lambda r, n: r.integers(-(2**60), 2**60, n), "constant": lambda r, n: np.full(n, 250), "mixed": lambda r, n: np.where(r.random(n) < 0.5, 0, r.lognormal(5, 3, n)),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [3, 500, 100_000])
def test_rank_error_is_under_one_percent(shape, n):
    v = SHAPES[shape](np.random.default_rng(n), n).astype(np.int64)
    assert rank_error(sketch(v), v) <= max(0.01, 0.6 / n)


def test_sums_and_deletions_are_exact():
    r = np.random.default_rng(1)
    a, b = r.lognormal(6, 1, 5000).astype(np.int64), r.integers(-500, 500, 3000)
    whole = sketch(np.r_[a, b])
    c = sketch(a)
    Q.merge(c, Q.pack(sketch(b)))
    assert (c == whole).all() and Q.count(c) == 8000
    Q.merge(c, Q.pack(sketch(a)), -1)
    assert (c == sketch(b)).all()
    Q.add(c, b, np.full(len(b), -1))
    assert not c.any() and Q.quantile(c, 0.5) is None and Q.pack(c) == b""


def test_codes_keep_order_and_small_values():
    r = np.random.default_rng(2)
    v = np.unique(np.r_[r.integers(-(2**62), 2**62, 5000), np.arange(-300, 300), 2**30 + np.arange(-3, 3), 2**53 + np.arange(-3, 3), 2**63 - 1, -(2**63)])
    c = Q.encode(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 2**Q.BITS
    assert all(Q.decode(int(k)) == x if abs(x) < 2**30 else abs(Q.decode(int(k)) - int(x)) <= abs(int(x)) * 2.0**-29 for k, x in zip(c, v.tolist()))


def test_days_combine_and_nulls_repeats_and_clashes(spark):
    day = 86_400_000
    data = [("m", "n", day * (i % 3), i, i) for i in range(900)] + [("m", "n", 0, 0, 0)] * 5 + [(None, "n", 5, 7, 1), ("m", "n", None, 5, 2), ("m", "n", 5, None, 3), ("m", "x", 5, -4, 4)]
    df = spark.createDataFrame([(*d, 0) for d in data], "module string, name string, t bigint, v bigint, id bigint, day int")
    s = Q.daily_summaries(df, "module", "name", "t", "v", "id").cache()
    assert {(r["k1"], r["k2"], r["day"]): r["n"] for r in s.collect()} == {("m", "n", 0): 300, ("m", "n", 1): 300, ("m", "n", 2): 300, (None, "n", 0): 1, ("m", "x", 0): 1}
    got = {(r["k1"], r["k2"], r["q"]): (r["n"], r["value"]) for r in Q.percentiles(Q.combine(s)).collect()}
    assert got[("m", "x", 0.5)] == (1, -4) and got[(None, "n", 0.99)] == (1, 7)
    assert got[("m", "n", 0.5)][0] == 900 and abs(got[("m", "n", 0.5)][1] - 449) <= 9
    assert Q.combine(s, 2).count() == 4
    assert Q.percentiles(Q.combine(Q.daily_summaries(df.limit(0), "module", "name", "t", "v", "id"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, Q.LISTED, Q.LISTED + 1, 20_000])
def test_listed_summaries_have_the_counters_of_their_values(n):
    r = np.random.default_rng(n)
    v = r.permutation(3 * n)[:n] - n
    s = Q.Summary()
    for part in np.array_split(v, 3):
        s.add(Q.encode(part), np.ones(len(part), np.int64))
    c = np.zeros(Q.SIZE, np.int64)
    Q.merge(c, s.packed())
    assert (c == sketch(v)).all() and s.n() == n and (s.packed()[:1] == b"L") == (0 < n <= Q.LISTED)
    s.merge(sketch_blob(v[: n // 2]), -1)
    c[:] = 0
    Q.merge(c, s.packed())
    assert (c == sketch(v[n // 2 :])).all()


def sketch_blob(v):
    return Q.pack(sketch(v))


def test_deleting_days_gives_what_the_others_give(spark):
    day = 86_400_000
    data = [("m" if i % 5 else None, "n", day * (i % 4), i * 7919 % 10007, i) for i in range(4000)] + [("k", "n", day * 3, 5, 9999)]
    df = spark.createDataFrame(data, "module string, name string, t bigint, v bigint, id bigint")
    s = Q.daily_summaries(df, "module", "name", "t", "v", "id").cache()
    get = lambda x: sorted(((r["k1"] or "", r["n"], r["q"], r["value"]) for r in Q.percentiles(x).collect()))
    assert get(Q.subtract(Q.combine(s), Q.combine(s.where("day = 3")))) == get(Q.combine(s.where("day < 3")))
    assert len(get(Q.subtract(s, s.where("day < 3")))) == 12


def test_a_heavy_value_beside_the_target():
    r = np.random.default_rng(6)
    v = np.r_[np.full(90_000, 123_456), r.integers(123_400, 123_456, 4_000), r.integers(123_457, 124_000, 6_000)]
    assert rank_error(sketch(v), v) <= 0.01
