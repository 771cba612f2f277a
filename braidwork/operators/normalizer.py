"""Domain normalisation: sufficient statistics of token log-ratios, bounded multipliers, and their modes.

All statistics are float64 sums, so partial aggregates merge by addition; the only shuffle is one row per domain and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Variances below this share of the mean square count as zero.
GUARD = 1e-12
LOW, HIGH = 0.25, 4.0


def sufficient_stats(tokens: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(domain, responses, tokens, s, q) from tokens (domain, sample_id, r, mask): masked tokens never count, whatever their
    value; a response without valid tokens is still a response. A valid token that is not finite is an error."""
    bad = F.col("mask") & (F.isnan("r") | F.col("r").isNull() | (F.abs("r") == float("inf")))
    valid = F.when(F.col("mask"), F.when(bad, F.raise_error(F.lit("non-finite log-ratio at a valid token")).cast("double")).otherwise(F.col("r")))
    sums = [F.count(valid).alias("tokens"), F.coalesce(F.sum(valid), F.lit(0.0)).alias("s"), F.coalesce(F.sum(valid * valid), F.lit(0.0)).alias("q")]
    if samples is None:
        return tokens.groupBy("domain").agg(F.countDistinct("sample_id").alias("responses"), *sums)
    counts = samples.groupBy("domain").agg(F.count(F.lit(1)).alias("responses"))
    stats = tokens.groupBy("domain").agg(*sums)
    zero = {"tokens": 0, "s": 0.0, "q": 0.0}
    return counts.join(stats, "domain", "left").fillna(zero)


def array_stats(responses: DataFrame) -> DataFrame:
    """As sufficient_stats from (domain, values): per-row sums by higher-order functions, so nothing is exploded."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    rows = responses.select("domain", F.size("values").alias("n"), total.alias("s"), square.alias("q"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("responses"), F.sum("n").cast("long").alias("tokens"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of all parts together."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("responses", "tokens", "s", "q")])


def population_std(n: Column, s: Column, q: Column) -> Column:
    """From sums; 0 for fewer than two values and for variances that are rounding noise."""
    mean_square = F.try_divide(q, n)
    mean = F.try_divide(s, n)
    var = mean_square - mean * mean
    return F.when((n < 2) | (var <= GUARD * mean_square), F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))


def multipliers(stats: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Adds sd, sd_all (of all tokens pooled, not a mean of deviations), measurable, raw, multiplier, clipped."""
    pool = stats.agg(F.sum("tokens").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    both = stats.crossJoin(F.broadcast(pool))  # one row
    both = both.withColumn("sd", population_std(F.col("tokens"), F.col("s"), F.col("q"))).withColumn("sd_all", population_std(F.col("_n"), F.col("_s"), F.col("_q")))
    both = both.withColumn("measurable", (F.col("sd") > 0) & (F.col("sd_all") > 0))
    both = both.withColumn("raw", F.when(F.col("measurable"), F.try_divide(F.col("sd_all"), F.col("sd"))).otherwise(1.0))
    both = both.withColumn("multiplier", F.least(F.lit(high), F.greatest(F.lit(low), F.col("raw"))))
    return both.withColumn("clipped", F.col("multiplier") != F.col("raw")).drop("_n", "_s", "_q")


def applied(found: DataFrame, mode: str, fixed: dict[str, float] | None = None, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Adds `applied`: dn applies the multiplier, observe 1, fixed given constants within the bounds."""
    if mode == "dn":
        return found.withColumn("applied", F.col("multiplier"))
    if mode == "observe":
        return found.withColumn("applied", F.lit(1.0))
    if mode != "fixed" or not fixed or any(not low <= v <= high for v in fixed.values()):
        raise ValueError("mode must be dn, observe or fixed with constants within the bounds")
    table = F.create_map(*[x for k, v in sorted(fixed.items()) for x in (F.lit(k), F.lit(v))])
    missing = F.raise_error(F.concat(F.lit("no constant for domain "), F.col("domain"))).cast("double")
    return found.withColumn("applied", F.coalesce(F.try_element_at(table, F.col("domain")), missing))


def frozen(found: DataFrame, step: str = "step") -> DataFrame:
    """Adds `applied` to multipliers per (step, domain): the first measurable one, from its step on; until then the
    measured value."""
    order = Window.partitionBy("domain").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("measurable"), F.col("multiplier")), ignorenulls=True).over(order)
    return found.withColumn("applied", F.coalesce(first, F.col("multiplier")))


def multipliers_by(stats: DataFrame, step: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """As multipliers, for each step by itself."""
    w = Window.partitionBy(step)
    n, s, q = (F.sum(c).over(w) for c in ("tokens", "s", "q"))
    both = stats.withColumn("sd", population_std(F.col("tokens"), F.col("s"), F.col("q"))).withColumn("sd_all", population_std(n, s, q))
    both = both.withColumn("measurable", (F.col("sd") > 0) & (F.col("sd_all") > 0))
    raw = F.when(F.col("measurable"), F.try_divide(F.col("sd_all"), F.col("sd"))).otherwise(1.0)
    return both.withColumn("raw", raw).withColumn("multiplier", F.least(F.lit(high), F.greatest(F.lit(low), raw)))


def scaled(tokens: DataFrame, weights: DataFrame, value: str = "adv", weight: str = "multiplier") -> DataFrame:
    """Tokens with `value` scaled by their domain's weight; a domain without weight is an error. One row per domain, so the
    planner broadcasts it when its size allows."""
    table = weights.select(F.col("domain").alias("_d"), F.col(weight).alias("_w"))
    joined = tokens.join(table, F.col("domain") == F.col("_d"), "left")
    missing = F.raise_error(F.concat(F.lit("no weight for domain "), F.col("domain"))).cast("double")
    return joined.withColumn(value, F.col(value) * F.coalesce("_w", missing)).drop("_d", "_w")
