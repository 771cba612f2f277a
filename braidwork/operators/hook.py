"""One update's batch of scored responses as one plan: targets by mode, injected trajectories, multipliers by domain, the audit
rows and the panel over them.

A batch has a row for each response: index, prompt_sha256, domain, label, status, correct, loss_mask (array<int>, null: all
tokens count), rollout_logp (array<double>), scores (map<string, array<double>>: a teacher's log-probability of each token).
Rows hold their tokens as arrays, so everything up to the multipliers is done in the row; what is shuffled is one row of sums
per domain, and the audit rows where they meet their memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import normalizer

#: Fixed value: the score of a token whose scoring failed.
SENTINEL = -1e9
MODES, SCALES = ("label", "dynamic", "pool"), ("dn", "observe", "fixed")


def _fail(kind: str, *parts: Column | str) -> Column:
    return F.raise_error(F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).cast(kind)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _masked(values: Column, mask: Column) -> Column:
    """The values at places where the mask is 1; all for a null mask."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"] != 0)
    return F.when(mask.isNull(), values).otherwise(F.transform(kept, lambda z: z["v"]))


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != SENTINEL)


def checked(batch: DataFrame, names: list[str]) -> DataFrame:
    """`batch` with response_length; a score or mask that is not whole is an error that tells the sample."""
    length = F.size(F.coalesce(F.element_at("scores", F.lit(names[0])), F.array().cast("array<double>")))
    known = F.array_sort(F.map_keys(F.coalesce("scores", F.expr("map()").cast("map<string,array<double>>")))) == F.lit(sorted(names))
    whole = F.forall(F.map_values("scores"), lambda v: v.isNotNull() & (F.size(v) == length) & F.forall(v, _usable))
    mask = F.col("loss_mask").isNull() | ((F.size("loss_mask") == length) & F.exists("loss_mask", lambda m: m != 0))
    fine = F.when(~F.coalesce(known, F.lit(False)), _fail("int", "teachers of sample", F.col("index"))).when((length == 0) | ~F.coalesce(whole, F.lit(False)), _fail("int", "scores of sample", F.col("index"))).when(~F.coalesce(mask, F.lit(False)), _fail("int", "mask of sample", F.col("index")))
    return batch.withColumn("response_length", fine.otherwise(length))


def targets(batch: DataFrame, names: list[str], mode: str, route: dict[str, str], default: str) -> DataFrame:
    """Adds teacher_mean_logp, current_argmin, label_teacher, applied and target. label applies the routed teacher, dynamic
    the one with the least mean score (the first by name of equals), pool the even mixture of all."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    rows = checked(batch, names)
    ordered = sorted(names)
    of = lambda name: F.element_at("scores", F.lit(name))
    tokens = [_masked(of(n), F.col("loss_mask")) for n in ordered]
    rows = rows.withColumn("teacher_mean_logp", F.create_map(*[x for n, t in zip(ordered, tokens, strict=True) for x in (F.lit(n), _sum(t) / F.size(t))]))
    means = F.array(*[F.struct(F.element_at("teacher_mean_logp", F.lit(n)).alias("mean"), F.lit(n).alias("name")) for n in ordered])
    alias = F.coalesce(F.when(F.col("label") == "", F.lit(None)).otherwise(F.col("label")), F.lit("default"))
    table = F.create_map(*[F.lit(x) for kv in {**route, "default": default}.items() for x in kv])
    rows = rows.withColumn("current_argmin", F.array_min(means)["name"]).withColumn("label_teacher", F.coalesce(F.try_element_at(table, alias), alias))
    if mode == "pool":
        rest = F.arrays_zip(*[of(n).alias(f"t{i}") for i, n in enumerate(ordered)])

        def mixed(z: Column) -> Column:
            parts = [z[f"t{i}"] for i in range(len(ordered))]
            top = F.greatest(*parts) if len(parts) > 1 else parts[0]
            total = F.lit(0.0)
            for p in parts:
                total = total + F.exp(p - top)
            return top + F.log(total) - math.log(len(ordered))

        return rows.withColumn("applied", F.lit("pool")).withColumn("target", F.transform(rest, mixed))
    name = F.col("label_teacher") if mode == "label" else F.col("current_argmin")
    known = F.when(name.isin(*names), name).otherwise(_fail("string", "unregistered teacher", name))
    return rows.withColumn("applied", known).withColumn("target", F.element_at("scores", F.col("applied")))


def injection_step(batch: DataFrame, const: float, over: float, size: int) -> tuple[int, float]:
    """The batch's step and the constant of that step; a batch that does not begin at a multiple of its size is an error."""
    low = batch.agg(F.min("index")).first()[0]
    if low is None or low % size:
        raise ValueError(f"batch starts at sample {low}, not at a multiple of {size}")
    return low // size, const * max(0.0, 1 - (low // size) / over)


def injected(rows: DataFrame, bank: DataFrame, slots: int, constant: float) -> DataFrame:
    """Adds injected and inject_adv_const; of each group whose prompt the bank (prompt_sha256, bank_domain, bank_length,
    bank_logp) has, one response becomes the bank's: the first wrong one by index, else the first. With a constant of 0
    nothing is replaced and no verdict is read; else a missing verdict in a group that the bank covers is an error, and so are
    a bank row of another domain and one whose scores are not whole. The bank is joined by prompt, whatever its size."""
    none = rows.withColumn("injected", F.lit(False)).withColumn("inject_adv_const", F.lit(0.0)).withColumn("original_length", F.col("response_length"))
    if constant <= 0:
        return none
    usable = (F.size("bank_logp") == F.col("bank_length")) & (F.col("bank_length") > 0) & F.forall("bank_logp", lambda x: _usable(x) & (x <= 0))
    known = bank.select("prompt_sha256", "bank_domain", F.when(usable, F.col("bank_logp")).otherwise(_fail("array<double>", "bank row", F.col("prompt_sha256"))).alias("bank_logp"))
    met = rows.withColumn("group_index", F.expr(f"index div {slots}")).join(known, "prompt_sha256", "left")
    group = Window.partitionBy("group_index")
    verdict = F.when(F.col("bank_logp").isNull(), F.lit(False)).when(F.col("correct").isNull(), _fail("boolean", "no verdict of sample", F.col("index"))).otherwise(F.col("correct"))
    chosen = F.row_number().over(group.orderBy(verdict, "index")) == 1
    met = met.withColumn("_in", F.col("bank_logp").isNotNull() & chosen)
    same = F.when(~F.col("_in") | F.col("domain").eqNullSafe(F.col("bank_domain")), F.col("_in")).otherwise(_fail("boolean", "bank domain of", F.col("prompt_sha256")))
    met = met.withColumn("injected", same).withColumn("original_length", F.col("response_length"))
    put = lambda new, old: F.when(F.col("injected"), new).otherwise(old)
    met = met.withColumns({"target": put(F.col("bank_logp"), F.col("target")), "rollout_logp": put(F.col("bank_logp"), F.col("rollout_logp")), "loss_mask": put(F.lit(None).cast("array<int>"), F.col("loss_mask")), "response_length": put(F.size("bank_logp"), F.col("response_length"))})
    return met.withColumn("inject_adv_const", put(F.lit(constant), F.lit(0.0))).drop("_in", "bank_domain", "bank_logp", "group_index")


def differences(rows: DataFrame) -> DataFrame:
    """Adds delta, the differences of target and rollout at tokens that count (null where the rollout has none or is not
    whole), and their mean rollout_delta_mean."""
    fits = (F.size("rollout_logp") == F.size("target")) & F.forall("rollout_logp", _usable)
    d = F.when(F.coalesce(fits, F.lit(False)), _masked(F.zip_with("target", "rollout_logp", lambda a, b: a - b), F.col("loss_mask")))
    return rows.withColumn("delta", d).withColumn("rollout_delta_mean", F.try_divide(_sum(F.col("delta")), F.size("delta")))


def scaled(rows: DataFrame, scale: str, fixed: dict[str, float] | None = None) -> DataFrame:
    """Adds dnorm_measured_factor and dnorm_factor, the multiplier of the row's domain that is measured over the batch and the
    one that applies. A row without rollout scores is an error. There are as many multipliers as domains."""
    whole = F.when(F.col("delta").isNull(), _fail("array<double>", "no rollout scores of sample", F.col("index"))).otherwise(F.col("delta"))
    named = rows.withColumn("_domain", F.coalesce("domain", F.lit("unknown")))
    found = normalizer.multipliers(normalizer.array_stats(named.select(F.col("_domain").alias("domain"), whole.alias("values"))))
    table = normalizer.applied(found, scale, fixed).select(F.col("domain").alias("_domain"), F.col("multiplier").alias("dnorm_measured_factor"), F.col("applied").alias("dnorm_factor"))
    return named.join(table, "_domain", "left").drop("_domain")


def memory(audit: DataFrame, before: int, mode: str) -> DataFrame:
    """(prompt_sha256, slot, index, teacher): what each prompt's slot was last given, from audit rows (update, mode,
    prompt_sha256, slot, index, applied, current_argmin) of samples before the place where a run goes on. Of rows of one sample
    the latest update's counts; rows of another mode are an error."""
    own = F.when(F.col("mode") == mode, F.col("applied") if mode != "pool" else F.col("current_argmin")).otherwise(_fail("string", "audit rows of mode", F.col("mode")))
    latest = audit.select("update", "prompt_sha256", "slot", "index", own.alias("teacher")).where(F.col("index") < before)
    latest = latest.groupBy("index").agg(F.max_by(F.struct("prompt_sha256", "slot", "teacher"), "update").alias("r")).select("index", "r.*")
    return latest.groupBy("prompt_sha256", "slot").agg(F.max("index").alias("index"), F.max_by("teacher", "index").alias("teacher"))


def audited(rows: DataFrame, slots: int, mode: str, known: DataFrame | None = None) -> DataFrame:
    """Adds slot, group_index, repeat and switched: whether the prompt's slot was met before, in `known` (as memory() gives
    it) or earlier in the batch, and whether its teacher changed. Rows of one prompt and slot meet, a few for each epoch."""
    at = rows.withColumn("slot", (F.col("index") % slots).cast("int")).withColumn("group_index", F.expr(f"index div {slots}"))
    at = at.withColumn("mode", F.lit(mode)).withColumn("_teacher", F.col("applied") if mode != "pool" else F.col("current_argmin"))
    before = F.lag("_teacher").over(Window.partitionBy("prompt_sha256", "slot").orderBy("index"))
    if known is not None:
        at = at.join(known.select("prompt_sha256", "slot", F.col("teacher").alias("_known")), ["prompt_sha256", "slot"], "left")
        before = F.coalesce(before, F.col("_known"))
    out = at.withColumn("_before", before).withColumn("repeat", F.col("_before").isNotNull())
    return out.withColumn("switched", F.coalesce(F.col("_before") != F.col("_teacher"), F.lit(False))).drop("_before", "_teacher", "_known")


def panel(audit: DataFrame) -> DataFrame:
    """One row over an update's audit rows: counts by (domain, teacher) first, so what meets is a few rows, then all measures
    and maps from them. A rate without repeated prompts is null."""
    routed = F.when(F.col("mode") == "pool", F.col("current_argmin")).otherwise(F.col("applied"))
    one = lambda c: F.sum(c.cast("long"))
    has = {c for c in audit.columns}
    cells = audit.withColumns({"_d": F.coalesce("domain", F.lit("unknown")), "_t": routed}).groupBy("mode", "_d", "_t").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("low"), one(F.col("_t") == F.col("label_teacher")).alias("agree"), one(F.col("applied") != F.col("current_argmin")).alias("differ"),
        one(F.col("repeat")).alias("repeats"), one(F.col("switched")).alias("switches"), F.sum("response_length").alias("lengths"), one(F.col("status") == "truncated").alias("cut"),
        F.sum("rollout_delta_mean").alias("delta"), F.count("rollout_delta_mean").alias("deltas"), one(F.col("injected") if "injected" in has else F.lit(False)).alias("put"),
    )
    n = F.sum("n")
    first = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    by = lambda keys, value, name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys.alias("k"), value.alias("v"))), first)).alias(name)
    total = cells.groupBy("mode").agg(
        n.alias("n"), F.min("low").alias("iteration_first_index"), (F.sum("agree") / n).alias("label_agreement"), F.when(F.col("mode") != "pool", F.sum("differ") / n).alias("shadow_argmin_disagreement"),
        F.sum("repeats").alias("repeat_prompts"), F.try_divide(F.sum("switches"), F.sum("repeats")).alias("repeat_switch_rate"), (F.sum("lengths") / n).alias("mean_response_length"), (F.sum("cut") / n).alias("truncation_rate"), (F.sum("put") / n).alias("injected_share"),
    )
    whole = F.sum("n").over(Window.partitionBy("mode"))
    share = cells.groupBy("mode", "_t").agg(n.alias("n")).withColumn("x", F.col("n") / whole).groupBy("mode").agg(by(F.col("_t"), F.col("x"), "share"))
    in_domain = cells.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy("mode", "_d"))).groupBy("mode", "_d").agg(by(F.col("_t"), F.col("x"), "shares"), F.sum("delta").alias("delta"), F.sum("deltas").alias("deltas"), F.sum("put").alias("put"))
    domains = in_domain.groupBy("mode").agg(by(F.col("_d"), F.col("shares"), "share_by_domain"), by(F.col("_d"), F.struct(F.col("deltas").alias("n"), F.try_divide("delta", "deltas").alias("mean_delta")), "rollout_delta_by_domain"), by(F.col("_d"), F.col("put"), "injected_by_domain"))
    return total.join(share, "mode").join(domains, "mode")


def batch(samples: DataFrame, names: list[str], mode: str, route: dict[str, str], default: str, slots: int, scale: str | None = None, fixed: dict[str, float] | None = None, known: DataFrame | None = None, bank: DataFrame | None = None, constant: float = 0.0) -> DataFrame:
    """The audit rows of one update, tokens left out: targets, injections, multipliers and memory in one plan. Multipliers
    belong to the label mode, and not with injections."""
    if scale is not None and (mode != "label" or bank is not None or scale not in SCALES):
        raise ValueError("multipliers are dn, observe or fixed, for the label mode without injections")
    rows = targets(samples, names, mode, route, default)
    rows = differences(injected(rows, bank, slots, constant) if bank is not None else rows)
    rows = scaled(rows, scale, fixed) if scale is not None else rows
    return audited(rows, slots, mode, known).drop("scores", "loss_mask", "rollout_logp", "target", "delta")
