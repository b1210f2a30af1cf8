import numpy as np

from tarnwheel.operators import grid as G

from .conftest import rows

SCHEMA = "w bigint, t bigint, v bigint, source string, slot int"
M = 60_000


def series(spark, data, **kw):
    df = spark.createDataFrame([(*x, "x", 1) for x in data], SCHEMA)
    return G.regular_series(df, "w", "t", "v", **kw)


def test_observed_cells_are_exact_and_holes_lie_between(spark):
    data = [(1, i * M + 7, 100 * i) for i in range(40) if i not in (20, 21)] + [(1, 5 * M + 9, 501), (1, 3 * M, None), (1, 4 * M + 50, -1), (None, 1, 1), (1, None, 1)]
    got = {r[0]: (r[1], r[2]) for r in rows(series(spark, data), "slot_ms", "state", "value")}
    assert got[5 * M] == ("observed", 501.0) and got[19 * M] == ("observed", 1900.0)
    assert sorted(k for k, v in got.items() if v[0] != "observed") == [20 * M, 21 * M]
    assert got[20 * M][0] == "filled" and 1900 < got[20 * M][1] < got[21 * M][1] < 2200


def test_sources_without_support_are_marked_and_long_gaps_are_pauses(spark):
    data = [(1, 0, 5), (1, 3 * M, 9), (1, 3 * M + 7_200_001, 10), (2, 0, 1)]
    got = rows(series(spark, data), "w", "slot_ms", "state", "n_slots")
    assert (1, M, "marked", 1) in got and (1, 2 * M, "marked", 1) in got
    assert [g for g in got if g[2] == "pause"] == [(1, 4 * M, "pause", 119)]
    assert (2, 0, "observed", 1) in got


def test_gap_of_exactly_the_limit_over_midnight(spark):
    a = 86_400_000 - M
    got = rows(series(spark, [(1, a, 1), (1, a + 7_200_000, 2)]), "slot_ms", "state")
    assert [s for s, k in got if k == "marked"] == [a + M * i for i in range(1, 120)]


def test_restart_goes_on_at_the_sources_own_pace(spark):
    data = [(1, i * M, 10 * i) for i in range(30)] + [(1, (33 + i) * M, 5 + 10 * i) for i in range(10)]
    got = {r[0]: r[2] for r in rows(series(spark, data), "slot_ms", "state", "value") if r[1] == "filled"}
    assert len(got) == 3 and 290 < got[30 * M] < got[31 * M] < got[32 * M] < 400


def test_als_recovers_a_rank_one_pattern():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 1)) @ rng.normal(size=(1, 60)) * 3
    seen = rng.random(x.shape) < 0.7
    u, v = G.als(x, seen, rank=1, rounds=20, ridge=1e-6)
    assert np.abs(u @ v.T - x)[~seen].max() < 1e-3
    assert np.isfinite(np.concatenate(G.als(np.zeros((3, 4)), np.zeros((3, 4), bool)))).all()


def test_empty_and_repeats(spark):
    assert series(spark, []).count() == 0
    assert series(spark, [(1, 5, 5), (1, 5, 5)]).count() == 1


def test_held_out_cells_are_near_what_was_read(spark):
    """Runs of slots are taken out of real series; the filled counters are compared with the readings taken out."""
    from pyspark.sql import functions as F

    s = spark.read.parquet("/root/testdata/sf0.01/worker_samples.parquet").select("worker_id", "epoch_ms", "net_read_bytes").where("net_read_bytes >= 0")
    s = s.withColumn("slot", F.floor(F.col("epoch_ms") / M))
    out = F.pmod(F.xxhash64("worker_id", F.floor(F.col("slot") / 4)), F.lit(9)) == 0
    truth = G.slots(s, "worker_id", "epoch_ms", "net_read_bytes", M).select("source", (F.col("slot") * M).alias("slot_ms"), F.col("value").alias("true"))
    got = G.regular_series(s.where(~out), "worker_id", "epoch_ms", "net_read_bytes", pauses=False).where("state = 'filled'")
    j = got.join(truth, (F.col("worker_id") == F.col("source")) & (got["slot_ms"] == truth["slot_ms"])).withColumn("err", F.abs(F.col("value") - F.col("true")) / F.greatest(F.col("true"), F.lit(1)))
    n, mid = j.agg(F.count(F.lit(1)), F.percentile_approx("err", 0.5)).first()
    assert n > 300 and mid < 0.02


def test_slots_that_no_source_observes_are_marked(spark):
    data = [(w, i * M, 10 * w * i) for w in (1, 2) for i in range(40) if not (20 <= i < 23) and not (w == 1 and i == 30)]
    got = {(r[0], r[1] // M): r[2:] for r in rows(series(spark, data), "w", "slot_ms", "state", "value") if r[2] != "observed"}
    assert {k: s for k, (s, _) in got.items()} == {(1, 30): "filled"} | {(w, i): "marked" for w in (1, 2) for i in (20, 21, 22)}
    assert all((v is None) == (s == "marked") for s, v in got.values())


def test_als_goes_on_until_its_objective_is_still():
    rng = np.random.default_rng(2)
    u, v = rng.normal(1, 1, (30, 2)), rng.normal(1, 1, (200, 2))
    x = u @ v.T + rng.normal(0, 0.05, (30, 200))
    seen = rng.random(x.shape) < 0.6
    a, b = G.als(x, seen)
    held = ~seen
    assert np.sqrt(((x - a @ b.T)[held] ** 2).mean()) < 0.2 * np.sqrt(((x - x[seen].mean())[held] ** 2).mean())
    one, more = (G.als(x, seen, rounds=k, still=0.0) for k in (1, 40))
    gap = lambda f: ((x - f[0] @ f[1].T)[seen] ** 2).sum()
    assert gap((a, b)) < gap(one) and gap((a, b)) < 1.2 * gap(more)
