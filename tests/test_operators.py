import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import evaluation, groups, normalizer, partitioning, prompts, rollouts, tokens
from braidwork.plans import queries as plans
from braidwork.plans import views


def _tokens(spark, rows):
    return spark.createDataFrame(rows, "domain string, sample_id long, r double, mask boolean")


def test_multipliers_follow_the_pooled_deviation(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.gauss(m, s), rng.random() < 0.8) for d, m, s in (("a", 0, 0.3), ("b", 1, 1.0), ("c", -1, 6.0)) for i in range(60) for _ in range(5)]
    rows += [("d", 1, 2.0, True), ("d", 2, 2.0, True), ("e", 1, 0.0, False)]
    got = {r.domain: r for r in normalizer.multipliers(normalizer.sufficient_stats(_tokens(spark, rows))).collect()}
    every = np.array([r for _, _, r, m in rows if m])
    for d in "abc":
        sd = np.std([r for x, _, r, m in rows if x == d and m])
        assert math.isclose(got[d].multiplier, min(4, max(0.25, every.std() / sd)), rel_tol=1e-9)
    assert got["d"].multiplier == 1 and got["d"].sd == 0 and got["e"].tokens == 0 and got["e"].responses == 1


def test_merged_statistics_equal_the_whole(spark):
    rows = [("ab"[i % 2], i // 3, float(i), True) for i in range(60)]
    whole = normalizer.sufficient_stats(_tokens(spark, rows))
    parts = normalizer.merge_stats(*[normalizer.sufficient_stats(_tokens(spark, [r for r in rows if r[1] % 2 == k])) for k in (0, 1)])
    assert sorted(whole.collect()) == sorted(parts.select(*whole.columns).collect())


def test_non_finite_valid_token_is_an_error(spark):
    with pytest.raises(Exception):
        normalizer.sufficient_stats(_tokens(spark, [("a", 1, float("nan"), True)])).collect()
    ok = normalizer.sufficient_stats(_tokens(spark, [("a", 1, float("nan"), False), ("a", 1, 1.0, True)])).collect()
    assert ok[0].s == 1.0


def test_frozen_keeps_the_first_measurable(spark):
    df = spark.createDataFrame([(1, "a", 1.0, False), (2, "a", 2.0, True), (3, "a", 3.0, True)], "step int, domain string, multiplier double, measurable boolean")
    assert [r.applied for r in normalizer.frozen(df).orderBy("step").collect()] == [1.0, 2.0, 2.0]


def test_returns_and_gae(spark):
    rng = random.Random(2)
    r, v = [rng.random() for _ in range(9)], [rng.random() for _ in range(9)]
    df = spark.createDataFrame([(r, v)], "r array<double>, v array<double>")
    row = df.select(tokens.discounted(F.col("r"), 0.9).alias("g"), tokens.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("a")).first()
    g = a = 0.0
    for i in reversed(range(9)):
        g = r[i] + 0.9 * g
        a = r[i] + 0.9 * (v[i + 1] if i < 8 else 0) - v[i] + 0.72 * a
        assert math.isclose(row.g[i], g) and math.isclose(row.a[i].a, a) and math.isclose(row.a[i].ret, a + v[i])


def test_pass_at_k(spark):
    df = spark.createDataFrame([(1, s, float(s < 3)) for s in range(8)], "group_index int, slot int, reward double")
    got = {r.k: r.pass_rate for r in groups.pass_rates(df).collect()}
    assert set(got) == {1, 2, 4, 8} and math.isclose(got[2], 1 - math.comb(5, 2) / math.comb(8, 2)) and got[8] == 1


def test_balance_extremes(spark):
    df = spark.createDataFrame([(1, s, 0.0, (None if s == 5 else s < 4)) for s in range(6)] + [(2, 0, 0.0, True)], "group_index int, slot int, reward double, correct boolean")
    count = lambda r: {(x.group_index, x.ok): x.n for x in groups.balanced(df, r).where("keep").groupBy("group_index", F.coalesce("correct", F.lit(False)).alias("ok")).agg(F.count("*").alias("n")).collect()}
    assert sum(count(1.0).values()) == 4
    assert set(count(0).keys()) == {(1, False)} and sum(n for (g, c), n in count(float("inf")).items()) == 5


def test_greedy_mask(spark):
    rows = [(1, 0, 0.1, True), (1, 1, 0.9, True), (1, 2, 0.8, False), (1, 3, 0.0, False)]
    df = spark.createDataFrame(rows, "group_index long, slot int, reward double, correct boolean")
    assert {r.slot for r in groups.greedy_margin_mask(df, 0.8).where("masked").collect()} == {0, 2}
    assert {r.slot for r in groups.greedy_margin_mask(df, 0.4).where("masked").collect()} == {0}


def test_levels_are_null_without_a_suite(spark):
    df = spark.createDataFrame([("m", "x", "1", 0.5)], "model string, suite string, id string, score double")
    row = evaluation.levels(df, {"d": ["x", "y"]}, ["model"]).first()
    assert row.x == 50 and row.y is None and row.d is None and row.total is None


def test_duplicate_question_is_an_error(spark):
    df = spark.createDataFrame([("m", "1", "10"), ("m", "1", "11")], "model string, id string, correct string")
    with pytest.raises(Exception):
        evaluation.question_scores(df, ["model"]).collect()


def test_partitions():
    costs = [9, 8, 7, 6, 5, 4]
    parts = partitioning.differencing(costs, 2)
    assert sorted(i for p in parts for i in p) == list(range(6)) and abs(sum(costs[i] for i in parts[0]) - sum(costs[i] for i in parts[1])) <= 1
    assert partitioning.first_fit([5, 6, 5, 20], 10) == [[0, 2], [1], [3]]
    assert partitioning.chunks([3, 3, 5, 1], 6) == [[0, 1], [2, 3]]
    assert partitioning.least_loaded([3, 1, 1, 1], 2) == [[0], [1, 2, 3]]


def test_seeded_fill(spark):
    seeds = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "ord int, k string, label string")
    pool = spark.createDataFrame([(3, "a", "x"), (4, "b", "y"), (5, "b", "y"), (6, "c", None), (7, "d", "z")], "ord int, k string, label string")
    assert sorted(r.ord for r in prompts.seeded_fill(seeds, pool, "k", "ord", "label", 4).collect()) == [1, 2, 4, 7]


def test_longest_prefix_and_last_before(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "zz")], "id int, text string")
    cached = spark.createDataFrame([("ab",), ("abcd",), ("b",)], "prefix string")
    assert [(r.id, r.prefix) for r in prompts.longest_prefix(texts, cached).collect()] == [(1, "abcd")]
    events = spark.createDataFrame([("k", 1, "x"), ("k", 5, "y")], "k string, at int, v string")
    probes = spark.createDataFrame([("k", 5), ("k", 6), ("k", 1)], "k string, at int")
    assert {(r.at, r.v) for r in prompts.last_before(events, probes, ["k"], "at", "v").collect()} == {(5, "x"), (6, "y"), (1, None)}


def test_option_conflicts():
    for bad in ({"kl_coef": 1, "kl_loss_coef": 1}, {"estimator": "reinforce_plus_plus"}, {"rollout_logprobs": True, "tis": True}, {"estimator": "x"}):
        with pytest.raises(ValueError):
            tokens.validated(**{"estimator": "grpo", **bad})


def test_karmarkar_karp_parts_every_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = views.groups(spark, sf).select("teacher", "group_index", "slot", "length").collect()
    batches, want = {}, {}
    for r in sorted(rows):
        batches.setdefault((r.teacher, r.group_index // 500), []).append(r)
    for (t, b), rs in batches.items():
        for part, items in enumerate(partitioning.differencing([int(r.length) for r in rs], 8)):
            want |= {(t, b, rs[i].group_index, rs[i].slot): part for i in items}
    got = plans.karmarkar_karp(spark, sf).collect()
    assert len(got) == len(rows) == len(want)
    assert {(r.teacher, r.batch, r.group_index, r.slot): r.part for r in got} == want


def test_settings_of_layers():
    assert prompts.resolved({"a": None, "b": 2}, {"a": 1, "b": 3, "c": None}) == {"a": 1, "b": 2, "c": None}
    try:
        prompts.resolved({"x": 1}, {"a": 1})
    except KeyError:
        return
    raise AssertionError


def test_trimmed_with_ties(spark):
    rows = spark.createDataFrame([(i, 1 if i < 9 else None) for i in range(11)], "i long, k long")
    left = groups.trimmed(rows, ["k"], 5)
    assert left.count() == 10 and left.columns == ["i", "k"]


def test_places_number_sorted_rows(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "i long").repartition(7)
    rows, n = prompts.places(df, ["i"])
    assert n == 101 and all(r.place == r.i for r in rows.collect())


def test_streamed_groups_of_a_partition_are_whole(spark):
    rows = spark.createDataFrame([(g, s, float(s % 3), s % 2 == 0) for g in range(40) for s in range(5)], "group_index long, slot int, reward double, correct boolean")
    got = groups.greedy_margin_mask(rows.repartition(3), 0.5).collect()
    assert len(got) == 200 and len({tuple(sorted((r.slot, r.masked) for r in got if r.group_index == g)) for g in range(40)}) == 1


def test_weights_of_a_mixture(spark):
    one = spark.range(1)
    mean = lambda ws: one.select(tokens.log_weighted_mean_exp(F.array(F.lit(0.0), F.lit(-1.0)), F.array(*map(F.lit, ws)))).first()[0]
    assert mean([1.0, 0.0]) == 0.0 and abs(mean([0.5, 0.5]) - np.log((1 + np.exp(-1)) / 2)) < 1e-12
    for ws in ([0.5, 0.6], [1.5, -0.5], [1.0, 1.0]):
        with pytest.raises(Exception, match="add up to 1"):
            mean(ws)


def test_trimmed_ties_are_the_same_for_any_partitions(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    left = [sorted(r.id for r in groups.trimmed(rows.repartition(n), ["k"], 37).collect()) for n in (1, 3, 7)]
    assert left[0] == left[1] == left[2] and len(left[0]) == 74


def test_throughput_without_a_window(spark):
    """Rows of one status need not meet in a task; ties of the longest count, null lengths and seconds of 0 do not."""
    rows = [("a", 9, 3), ("a", 9, 0), ("a", 9, 1), ("a", 2, 4), ("a", None, 5), (None, 4, 2), ("b", None, 1)]
    df = spark.createDataFrame(rows, "status string, length int, seconds int").repartition(3)
    got = rollouts.throughput(df, ["status"], "length", "seconds")
    assert "Window" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {("a", 5, 29 / 13, 9, 6.0), (None, 1, 2.0, 4, 2.0), ("b", 1, None, None, None)}
