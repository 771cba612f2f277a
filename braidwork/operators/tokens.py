"""Token-level advantage and loss algebra: columns over the long token table, and higher-order forms over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The score that marks a failed teacher call.
FAILED = -100.0


def reverse_kl_advantage(teacher: Column, student: Column, valid: Column) -> Column:
    """teacher - student; 0 where invalid or where the teacher failed."""
    return F.when(valid & (teacher != F.lit(FAILED)), teacher - student).otherwise(0.0)


def clipped_surrogate(ratio: Column, adv: Column, low: float = 0.2, high: float | None = None) -> Column:
    high = low if high is None else high
    if not (0 <= low < 1 and high >= 0):
        raise ValueError("clip range must be within [0, 1) below and not negative above")
    return -F.least(ratio * adv, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * adv)


def policy_loss(ratio: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float | None = None) -> tuple[Column, Column]:
    """(loss, clipped): the greater of both forms; for negative advantages no more than `dual` times them."""
    one, two = -ratio * adv, -F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * adv
    loss = F.greatest(one, two)
    if dual is not None:
        loss = F.when(adv < 0, F.least(-F.lit(dual) * adv, loss)).otherwise(loss)
    return loss, (two > one).cast("double")


def approx_kl(logp: Column, ref: Column, kind: str = "k3") -> Column:
    """k1 log-ratio, k2 half its square, k3 and low_var_kl exp(-r) - 1 + r (the latter kept within 10)."""
    r = logp - ref
    forms = {"k1": r, "k2": r * r / 2, "k3": F.exp(-r) - 1 + r}
    forms["low_var_kl"] = F.least(F.greatest(forms["k3"], F.lit(-10.0)), F.lit(10.0))
    return forms[kind]


def sequence_mean(value: Column, mask: Column, by: list[str]) -> Column:
    """Mean over a sample's valid tokens, on each of its rows; 0 without valid tokens."""
    w = Window.partitionBy(*by)
    m = mask.cast("double")
    return F.sum(value * m).over(w) / F.greatest(F.sum(m).over(w), F.lit(1.0))


def sample_mean_loss(tokens: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Two-level mean: over valid tokens, then over responses (those without valid tokens count as 0)."""
    m = F.col("mask").cast("double")
    per = tokens.groupBy(*by).agg((F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("mean"), F.sum(F.col(value) * m).alias("sum"))
    return per.agg(F.sum("mean").alias("sum_of_means"), F.avg("mean").alias("mean_of_means"), F.sum("sum").alias("token_sum"), F.count(F.lit(1)).alias("responses"))


def truncated_is(old: Column, rollout: Column, low: float = 0.0, high: float = 2.0) -> tuple[Column, Column]:
    """(weight, clipped): importance ratio kept within bounds."""
    r = F.exp(old - rollout)
    w = F.least(F.greatest(r, F.lit(low)), F.lit(high))
    return w, (w != r).cast("double")


def ice_pop(old: Column, rollout: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """Importance ratio, 0 outside the bounds."""
    r = F.exp(old - rollout)
    return F.when((r >= low) & (r <= high), r).otherwise(0.0)


def whiten(df: DataFrame, value: str, out: str, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with statistics of the valid rows (Bessel-corrected from two on), applied to all rows.
    No valid row at all is an error."""
    m = F.col("mask").cast("double")
    stats = df.agg(F.sum(m).alias("_n"), F.sum(F.col(value) * m).alias("_s"), F.sum(F.col(value) * F.col(value) * m).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    var = F.col("_q") / F.col("_n") - mean * mean
    var = F.when(F.col("_n") >= 2, var * F.col("_n") / (F.col("_n") - 1)).otherwise(var)
    guard = F.when(F.coalesce(F.col("_n"), F.lit(0.0)) <= 0, F.raise_error(F.lit("no valid value")).cast("double")).otherwise(F.lit(0.0))
    stats = stats.select((mean + guard).alias("_mean"), F.greatest(var, F.lit(0.0)).alias("_var"))
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, white if shift_mean else white + F.col("_mean")).drop("_mean", "_var")


def discounted(rewards: Column, gamma: float) -> Column:
    """G_t = r_t + gamma G_{t+1} over an array, by one backward pass."""
    step = lambda acc, x: F.concat(F.array(x + F.lit(gamma) * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc)
    return F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), step)


def shaped(kl: Column, mask: Column, reward: Column, coef: float) -> Column:
    """-coef x kl per token, and the reward at the last valid one; no valid token is an error."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1)
    last = F.when(F.array_position(mask, 1) == 0, F.raise_error(F.lit("fully masked response")).cast("long")).otherwise(last)
    return F.transform(kl, lambda x, i: -F.lit(coef) * x + F.when(i == last, reward).otherwise(0.0))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Array of (advantage, return): delta_t + gamma lambda A_{t+1}, the value after the end 0."""
    zipped = F.transform(F.arrays_zip(rewards.alias("r"), values.alias("v")), lambda x, i: F.struct(x["r"].alias("r"), x["v"].alias("v"), F.coalesce(F.get(values, i + 1), F.lit(0.0)).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        ahead = F.coalesce(F.get(acc, F.lit(0))["a"], F.lit(0.0))
        a = x["r"] + F.lit(gamma) * x["n"] - x["v"] + F.lit(gamma * lam) * ahead
        return F.concat(F.array(F.struct(a.alias("a"), (a + x["v"]).alias("ret"))), acc)

    return F.aggregate(F.reverse(zipped), F.array().cast("array<struct<a:double,ret:double>>"), step)


def opsm(tokens: DataFrame, by: list[str], delta: float = 1e-4) -> DataFrame:
    """Adds keep: 0 where the advantage is negative and the sample's mean log-ratio (old - new) exceeds delta."""
    kl = sequence_mean(F.col("old_lp") - F.col("s_lp"), F.col("mask"), by)
    return tokens.withColumn("seq_kl", kl).withColumn("keep", F.when((F.col("adv") < 0) & (F.col("seq_kl") > delta), 0).otherwise(1))


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.2) -> tuple[Column, Column]:
    kept = old + F.least(F.greatest(value - old, F.lit(-clip)), F.lit(clip))
    one, two = (value - target) * (value - target), (kept - target) * (kept - target)
    return F.greatest(one, two), (two > one).cast("double")


def log_mean_exp(xs: Column) -> Column:
    """log of the mean of exponentials of an array, by its maximum."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)) / F.size(xs))


def aligned_scores(scores: Column, length: Column) -> Column:
    """The last `length` scores after the first position; short ones are padded at the head with the failure mark."""
    rest = F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
    tail = F.slice(rest, F.greatest(F.size(rest) - length, F.lit(0)) + 1, length)
    return F.concat(F.array_repeat(F.lit(FAILED), F.greatest(length - F.size(tail), F.lit(0))), tail)


ESTIMATORS = ("grpo", "gspo", "reinforce_plus_plus", "reinforce_plus_plus_baseline", "ppo", "opd")


def validated(estimator: str, kl_coef: float = 0.0, kl_loss_coef: float = 0.0, whiten: bool = False, rollout_logprobs: bool = False, tis: bool = False) -> str:
    """The constraints between options; raises where they conflict."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")
    if kl_coef and kl_loss_coef:
        raise ValueError("only one of kl_coef and kl_loss_coef may be set")
    if estimator.startswith("reinforce_plus_plus") and not whiten:
        raise ValueError(f"{estimator} needs whitening")
    if rollout_logprobs and tis:
        raise ValueError("rollout log-probabilities and truncated importance sampling exclude each other")
    return estimator


def advantages(tokens: DataFrame, estimator: str, kl_coef: float = 0.0, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """(sample_id, pos, adv) by the estimator, from tokens (sample_id, pos, mask, kl, reward, value, t_lp, s_lp)."""
    keys = ["sample_id"]
    if estimator in ("grpo", "gspo"):
        return tokens.select(*keys, "pos", F.col("reward").alias("adv"))
    if estimator == "opd":
        return tokens.select(*keys, "pos", reverse_kl_advantage(F.col("t_lp"), F.col("s_lp"), F.col("mask")).alias("adv"))
    if estimator == "reinforce_plus_plus_baseline":
        return tokens.select(*keys, "pos", (F.col("reward") - F.lit(kl_coef) * F.col("kl")).alias("adv"))
    rows = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "kl", F.col("mask").cast("int").alias("mask"), "value"))).alias("t"), F.max("reward").alias("reward"))
    rewards = shaped(F.col("t.kl"), F.col("t.mask"), F.col("reward"), kl_coef)
    if estimator == "ppo":
        adv = F.transform(gae(rewards, F.col("t.value"), gamma, lam), lambda x: x["a"])
    else:
        adv = discounted(rewards, gamma)
    both = rows.select(*keys, F.explode(F.arrays_zip(F.col("t.pos").alias("pos"), adv.alias("adv"))).alias("x"))
    return both.select(*keys, "x.pos", "x.adv")


def injected(advantage: Column, constant: Column) -> Column:
    """An injected sample's constant instead of its advantages; 0, or none, keeps them."""
    return F.when(constant > 0, constant).otherwise(advantage)


def near_teacher(log_prob: Column, teacher: Column, most: float) -> Column:
    """1 where the student is less than `most` away from the teacher, else 0: what its loss is multiplied by."""
    return (F.abs(log_prob - teacher) < most).cast("double")


def sft_loss(rows: DataFrame, log_prob: str, keys: list[str]) -> DataFrame:
    """One row: responses, and minus the mean over responses of the masked mean log-probability."""
    per = rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("mask"), F.col(log_prob))), F.lit(0.0)) / F.greatest(F.count_if(F.col("mask")), F.lit(1))).alias("_m"))
    return per.agg(F.count(F.lit(1)).alias("responses"), (-F.avg("_m")).alias("loss"))


def policy_total(policy: Column, entropy: Column, kl: Column, entropy_weight: float, kl_weight: float) -> Column:
    return policy - F.lit(entropy_weight) * entropy + F.lit(kl_weight) * kl


def log_weighted_mean_exp(values: Column, weights: Column) -> Column:
    """log of the sum of weights x exp(values); weights of 0 leave their value out. Negative weights, and weights that do not
    add up to 1 within 1e-6, are an error."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), weights.alias("w")), lambda x: x["w"] > 0)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(F.transform(pairs, lambda x: x["v"]))
    mean = top + F.log(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["w"] * F.exp(x["v"] - top)))
    fine = (F.abs(total - 1) <= 1e-6) & ~F.exists(weights, lambda w: w < 0)
    return F.when(fine, mean).otherwise(F.raise_error(F.lit("weights of a mixture must add up to 1")).cast("double"))


def teacher_target(mode: str, scores: Column, label: Column, means: Column) -> Column:
    """(target, applied) from maps of teachers to log-probabilities and to mean scores: the label's teacher, the one with the
    least mean (first by name in ties), or the pool of all. A teacher without a score is an error."""
    if mode == "pool":
        values = F.map_values(scores)
        return F.struct(log_weighted_mean_exp(values, F.transform(values, lambda v: 1.0 / F.size(values))).alias("target"), F.lit("pool").alias("applied"))
    least = F.array_min(F.transform(F.map_entries(means), lambda e: F.struct(e["value"].alias("m"), e["key"].alias("t"))))["t"]
    name = label if mode == "label" else least
    fail = F.raise_error(F.concat(F.lit("teacher without a score: "), F.coalesce(name, F.lit("none")))).cast("double")
    return F.struct(F.coalesce(F.try_element_at(scores, name), fail).alias("target"), name.alias("applied"))


def response_mask(mask: Column, length: Column) -> Column:
    """The mask, all ones where there is none; another length or no one at all is an error."""
    full = F.coalesce(mask, F.array_repeat(F.lit(1), length))
    fail = lambda what: F.raise_error(F.lit(what)).cast("array<int>")
    return F.when(F.size(full) != length, fail("mask and response differ in length")).when(~F.exists(full, lambda x: x == 1), fail("empty response mask")).otherwise(full)


def response_length(mask: Column) -> Column:
    """How many places there are from the first 1 on."""
    first = F.array_position(mask, 1)
    return F.when(first > 0, F.size(mask) - first + 1).otherwise(F.lit(0)).cast("long")


def one_end(ids: Column, end: int) -> Column:
    """The ids with just one end at their end."""
    kept = F.filter(F.transform(ids, lambda x, i: F.when(x != end, i)), lambda i: i.isNotNull())
    return F.concat(F.slice(ids, 1, F.coalesce(F.array_max(kept) + 1, F.lit(0))), F.array(F.lit(end)))


def subsequence(ids: Column, pattern: list[int]) -> Column:
    """Places, from 0, at which the pattern begins, of overlapping ones the first."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - len(pattern), F.lit(0))), lambda i: F.slice(ids, i + 1, len(pattern)) == F.array(*[F.lit(x) for x in pattern]))
    free = lambda a, i: F.when((F.size(a) == 0) | (F.element_at(a, -1) + len(pattern) <= i), F.concat(a, F.array(i))).otherwise(a)
    return F.aggregate(starts, F.array().cast("array<int>"), free)


def forward_flops(length: Column, layers: int, hidden: int, heads: int, groups: int, head_dim: int, inner: int, vocabulary: int) -> Column:
    """Floating-point operations of one causal forward pass over a sequence: projections, half the attention square, a gated
    feed-forward layer of three products, and the output."""
    n = length.cast("double")
    attention = 2 * n * hidden * heads * head_dim + 4 * n * hidden * groups * head_dim + 2 * n * n * heads * head_dim + 2 * n * heads * head_dim * hidden
    return layers * (attention + 6 * n * hidden * inner) + 2 * n * hidden * vocabulary
