"""Masks by margin, parts of one size and bins against literal loops."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from braidwork.operators import groups, partitioning

SCHEMA = "group_index long, slot int, reward double, correct boolean"


def greedy(rows, delta, least, kind):
    """Keys (group_index, slot) that go, sample by sample in exact fractions."""
    ok = sorted((Fraction(r[2]), r[:2]) for r in rows if r[3] and r[2] is not None)
    no = sorted((-Fraction(r[2]), r[:2]) for r in rows if not r[3] and r[2] is not None)
    keep = [max(1, int(len(side) * least)) for side in (ok, no)]
    gap = lambda a, b: sum(x for x, _ in a) / len(a) + sum(x for x, _ in b) / len(b) if kind == "mean" else a[0][0] + b[0][0]
    gone = set()
    while ok and no and gap(ok, no) < Fraction(delta):
        one = gap(ok[1:], no) if len(ok) > keep[0] else None
        two = gap(ok, no[1:]) if len(no) > keep[1] else None
        best = max((x for x in (one, two) if x is not None), default=None)
        if best is None or best <= gap(ok, no):
            break
        side = ok if one == best else no
        gone.add(side.pop(0)[1])
    return gone


def made(seed, n_groups, most):
    rng = random.Random(seed)
    return [(g, s, rng.choice([None] * 1 + [rng.randint(-16, 16) / 8] * 12), rng.choice([True, False, None])) for g in range(n_groups) for s in range(rng.randint(0, most))]


@pytest.mark.parametrize("kind", ["mean", "minmax"])
@pytest.mark.parametrize(("delta", "least"), [(1.0, 0.5), (3.0, 0.25), (10.0, 0.0), (-0.5, 0.8)])
def test_masks_of_groups(spark, kind, delta, least):
    rows = made(int(delta * 8) + 40, 60, 14)
    got = groups.greedy_margin_mask(spark.createDataFrame(rows, SCHEMA).repartition(4), delta, least, kind)
    want = {k for _, g in itertools.groupby(rows, key=lambda r: r[0]) for k in greedy(list(g), delta, least, kind)}
    found = got.collect()
    assert len(found) == len(rows) and {(r.group_index, r.slot) for r in found if r.masked} == want


@pytest.mark.parametrize("kind", ["mean", "minmax"])
@pytest.mark.parametrize(("delta", "least"), [(1.5, 0.5), (3.25, 0.1), (50.0, 0.3)])
def test_masks_of_all_rows(spark, kind, delta, least):
    rng = random.Random(int(delta))
    rows = [(g, s, r if r is None else r + rng.randint(0, 7) / 64, c) for g, s, r, c in made(7, 40, 12)]
    got = groups.global_margin_mask(spark.createDataFrame(rows, SCHEMA).repartition(5), delta, least, kind).collect()
    assert len(got) == len(rows) and {(r.group_index, r.slot) for r in got if r.masked} == greedy(rows, delta, least, kind)


def test_one_side_only(spark):
    rows = [(1, 0, 1.0, True), (1, 1, 2.0, True), (2, 0, None, False), (2, 1, 1.0, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert not any(r.masked for r in groups.greedy_margin_mask(df, 9.0).collect()) and groups.global_margin_mask(df.limit(0), 1.0).count() == 0
    assert not any(r.masked for r in groups.global_margin_mask(df.where("correct"), 9.0).collect())
    with pytest.raises(ValueError):
        groups.greedy_margin_mask(df, 1.0, kind="median")


def test_a_scope_of_many_rows_runs_split(spark):
    n = 600_000
    at = F.pmod(F.col("id") * 7919, F.lit(n))
    df = spark.range(n, numPartitions=8).select(F.expr("id div 10").alias("group_index"), (F.col("id") % 10).cast("int").alias("slot"), (at / n).alias("reward"), (F.col("id") % 2 == 0).alias("correct"))
    got = groups.global_margin_mask(df, 0.25)
    assert got.count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    left = df.join(got.where("not masked"), ["group_index", "slot"]).agg((F.avg(F.when(F.col("correct"), F.col("reward"))) - F.avg(F.when(~F.col("correct"), F.col("reward")))).alias("gap"), F.count(F.lit(1)).alias("n")).first()
    assert 0.25 <= left.gap < 0.2501 and n / 2 < left.n < n


def joined(costs, parts, equal):
    """The method by lists: of all partial partitions the two of the widest spread, again and again."""
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    starts = [order[i : i + (parts if equal else 1)] for i in range(0, len(order), parts if equal else 1)]
    total = lambda s: (sum(costs[i] for i in s), len(s), [(i, costs[i]) for i in s])
    states = [sorted([[i] for i in own] + [[]] * (parts - len(own)), key=total, reverse=True) for own in starts]
    while len(states) > 1:
        states.sort(key=lambda s: (total(s[0])[0] - total(s[-1])[0], total(s[0])), reverse=True)
        one, two, *states = states
        states.append(sorted((a + b for a, b in zip(one, two[::-1], strict=True)), key=total, reverse=True))
    return [sorted(s) for s in states[0]]


@pytest.mark.parametrize("equal", [True, False])
def test_differencing(equal):
    rng = random.Random(2)
    for _ in range(200):
        parts = rng.randint(2, 5)
        costs = [rng.randint(1, 9) for _ in range(parts * rng.randint(1, 5))]
        got = partitioning.differencing(costs, parts, equal)
        assert got == joined(costs, parts, equal) and sorted(itertools.chain(*got)) == list(range(len(costs)))
        if equal:
            assert {len(p) for p in got} == {len(costs) // parts}
    with pytest.raises(ValueError):
        partitioning.differencing([1, 2, 3], 2, True)


def test_first_fit():
    rng = random.Random(4)
    for _ in range(200):
        costs, cap = [rng.randint(0, 12) for _ in range(rng.randint(0, 40))], 10
        bins: list[list[int]] = []
        for i, c in enumerate(costs):
            fits = next((b for b in bins if sum(costs[j] for j in b) + c <= cap), None)
            bins.append([i]) if fits is None else fits.append(i)
        assert partitioning.first_fit(costs, cap) == bins


@pytest.mark.parametrize("run", [lambda df: groups.greedy_margin_mask(df, 0.5), lambda df: groups.balanced(df, 1.0)])
def test_tasks_are_sized_by_their_rows(spark, monkeypatch, run):
    """More rows make more tasks, not greater ones, with the same results."""
    rows = spark.range(600).select((F.col("id") % 90).alias("group_index"), (F.col("id") / 90).cast("int").alias("slot"), (F.col("id") % 7 / 7).alias("reward"), (F.col("id") % 3 == 0).alias("correct"))
    want = sorted(map(tuple, run(rows).collect()))
    monkeypatch.setattr(partitioning, "SORTED", 30)
    assert sorted(map(tuple, run(rows).collect())) == want
    made = run(rows)._jdf.queryExecution().toString()
    assert "hashpartitioning(group_index" in made and ", 20), REPARTITION_BY_NUM" in made
