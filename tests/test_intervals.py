"""Intervals from tasks against one generator run in a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import intervals

SUITES = ["b", "a", "c"]


@pytest.mark.parametrize(("n", "first"), [(2, 0), (3, 7), (541, 100), (10_000, 3), (2**31 + 7, 0), (3 * 10**9, 5), (1, 4)])
def test_draws_are_the_generators(n, first):
    """Also with many numbers refused, from an even and an odd place."""
    rng = np.random.default_rng(5)
    rng.integers(0, 2**20, size=first)  # takes one number each
    assert (intervals.drawn(5, first, n, 999) == rng.integers(0, n, size=999)).all()


def test_calls_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CHUNK", 1 << 12)
    calls = [(3 * 10**9, 5001), (1, 77), (2**31 + 5, 3000), (541, 4000), (3 * 10**9, 10), (2, 5)]
    found = intervals.draws(spark, calls, 11)
    rng = np.random.default_rng(11)
    for i, (n, count) in enumerate(calls):
        want = rng.integers(0, n, size=count)
        for at in (0, count // 3, count - 1):
            assert (intervals.drawn(11, found.at(i, at), n, count - at) == want[at:]).all()


def pairs(spark, keys):
    rng = np.random.default_rng(3)
    rows = [(k, s, f"q{i:03d}", float(rng.integers(0, 5)) / 4, float(rng.integers(0, 5)) / 4) for k in keys for s, n in (("a", 41), ("b", 17), ("c", 1 if k == 43 else 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key int, suite string, id string, sa double, sb double").repartition(5)


def serial(rows, key, rng, replicates):
    point, out = 0.0, np.zeros(replicates)
    for s in SUITES:
        own = sorted(r[2:] for r in rows if r[0] == key and r[1] == s)
        va, vb = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        at = rng.integers(0, len(own), size=(replicates, len(own)))
        point += 100 * (va.mean() - vb.mean()) / len(SUITES)
        out += 100 * (va[at].mean(axis=1) - vb[at].mean(axis=1)) / len(SUITES)
    return point, out


def test_bootstrap_in_slices(spark, monkeypatch):
    monkeypatch.setattr(intervals, "DRAWN", 3000)
    rows, df = pairs(spark, [1, 2, 43])
    of = intervals.replicates_of(df, ["key"], SUITES, 1000)
    got = {(r.key, r.replicate): r.delta for r in of.collect()}
    for key in (1, 2, 43):
        _, want = serial(rows, key, np.random.default_rng(intervals.SEED), 1000)
        assert [got[key, i] for i in range(1000)] == want.tolist()
    for r in intervals.bootstrap(df, ["key"], SUITES, 1000).collect():
        point, want = serial(rows, r.key, np.random.default_rng(intervals.SEED), 1000)
        assert abs(r.delta - point) < 1e-9 and [r.lo, r.hi] == np.percentile(want, [2.5, 97.5]).tolist()


def test_slices_are_tasks(spark):
    _, df = pairs(spark, [1])
    plan = intervals.replicates_of(df, ["key"], SUITES, 500)
    assert "FlatMapGroupsInPandas" in plan._jdf.queryExecution().toString() and plan.where("replicate < 0").count() == 0


def test_what_is_moved_grows_with_the_questions(spark, monkeypatch):
    """Few draws at a time make no more rows than slices; many refusals are gathered as counts of chunks."""
    monkeypatch.setattr(intervals, "DRAWN", 50)
    monkeypatch.setattr(intervals, "SLICES", 3)
    rows, df = pairs(spark, [1])
    of = intervals.replicates_of(df, ["key"], SUITES, 200)
    _, want = serial(rows, 1, np.random.default_rng(intervals.SEED), 200)
    assert [r.delta for r in of.orderBy("replicate").collect()] == want.tolist()
    plans = {(41, 17, 30): (intervals.draws(spark, [(n, n * 200) for n in (17, 41, 30)], intervals.SEED), 0)}
    made = []
    keep = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a: made.append(len(data)) or keep(data, *a))
    intervals._resampled(df, ["key"], SUITES, 200, intervals.SEED, plans, keep([(1, 0)], "key int, plan int"))
    assert made == [9]
    monkeypatch.setattr(intervals, "CHUNK", 1 << 12)
    found = intervals.draws(spark, [(5, 30), (3 * 10**9, 100_000)], 11)
    first, refusals = found.refused[3 * 10**9]
    assert first == 0 and len(refusals) < 50 and refusals.max() > 1000


def test_seeds_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(intervals, "DRAWN", 3000)
    rows, df = pairs(spark, [42, 43, 44])
    rng, per = np.random.default_rng(9), {}
    for key in (42, 43, 44):
        per[key] = serial(rows, key, rng, 800)
    table, total = np.stack([per[k][1] for k in (42, 43, 44)]), np.zeros(800)
    for _ in range(3):
        pick, col = rng.integers(0, 3, size=800), rng.integers(0, 800, size=800)
        total += table[pick, col] / 3
    got = {r.key: r for r in intervals.seed_read(df, "key", [42, 43, 44], SUITES, 800, 9).collect()}
    for key in (42, 43, 44):
        assert [got[key].lo, got[key].hi] == np.percentile(per[key][1], [2.5, 97.5]).tolist()
    assert [got[None].lo, got[None].hi] == np.percentile(total, [2.5, 97.5]).tolist()
    assert abs(got[None].delta - np.mean([per[k][0] for k in per])) < 1e-9
    with pytest.raises(ValueError):
        intervals.seed_read(df.where(F.col("key") != 44), "key", [42, 43, 44], SUITES, 80)


def test_scores_are_packed(spark):
    """A slice gets few rows, however many questions there are, which are all there in the order of their ids."""
    rows = [(1, "a", f"q{i:05d}", i / 7, -i / 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, suite string, id string, sa double, sb double").repartition(5)
    got = intervals._packed(df, ["key"], ["a"]).orderBy("chunk").collect()
    assert len(got) < 20
    assert [np.frombuffer(b"".join(r[c] for r in got)).tolist() for c in "ab"] == [[r[k] for r in rows] for k in (3, 4)]
