"""Rollout batches: budgets, verdicts, scored responses, merged turns, throughput, parameter tables, consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import ranges


def token_budget(most: Column | int, context: int, used: Column) -> tuple[Column, Column]:
    """(budget, status): what may still be generated; nothing left means no request and a truncated sample."""
    left = F.least(F.lit(most) if isinstance(most, int) else most, F.lit(context) - used)
    return F.greatest(left, F.lit(0)), F.when(left <= 0, "truncated").otherwise("pending")


def strict_verdict(flag: Column, score: Column) -> Column:
    """True by the flag or by a score of 1 or more; without either an error."""
    missing = F.raise_error(F.lit("no verdict")).cast("boolean")
    return F.when(flag.isNotNull(), flag).when(score.isNotNull(), score >= 1.0).otherwise(missing)


def starts_alike(short: Column, long: Column) -> Column:
    """Whether one array is the other's beginning."""
    return F.slice(long, 1, F.size(short)) == short


def merged_turns(a: Column, observed: Column, b: Column) -> tuple[Column, Column]:
    """(tokens, mask) of two responses with an observation between them, which is masked out."""
    ones = lambda x: F.array_repeat(F.lit(1), F.size(x))
    return F.concat(a, observed, b), F.concat(ones(a), F.array_repeat(F.lit(0), F.size(observed)), ones(b))


def applied_mask(mask: Column, length: Column, removed: Column) -> Column:
    """All ones where there is no mask; all zeros for removed samples, whose rows stay."""
    full = F.coalesce(mask, F.array_repeat(F.lit(1), length))
    return F.when(removed, F.transform(full, lambda x: F.lit(0))).otherwise(full)


def fan_out(samples: DataFrame, teachers: list[str], scores: DataFrame, keys: list[str]) -> DataFrame:
    """Every sample for every teacher, with its score or null. The teachers are configuration, so they are exploded."""
    every = samples.withColumn("teacher", F.explode(F.array(*[F.lit(t) for t in teachers])))
    return every.join(scores, [*keys, "teacher"], "left")


def throughput(rows: DataFrame, by: list[str], tokens: str, seconds: str) -> DataFrame:
    """by, n, tokens_per_second (ratio of sums), longest (tokens), longest_rate: the mean rate of the longest rows, ties
    included."""
    # By length first, which map tasks combine: the rows of one `by` never meet in a task.
    rate = F.avg(F.try_divide(F.col(tokens), F.col(seconds)))
    per = rows.groupBy(*by, F.col(tokens).alias("_tokens")).agg(F.count(F.lit(1)).alias("_n"), F.sum(tokens).alias("_sum"), F.sum(seconds).alias("_seconds"), rate.alias("_rate"))
    return per.groupBy(*by).agg(F.sum("_n").alias("n"), F.try_divide(F.sum("_sum"), F.sum("_seconds")).alias("tokens_per_second"), F.max("_tokens").alias("longest"), F.max_by("_rate", "_tokens").alias("longest_rate"))


def contiguity(rows: DataFrame, index: str) -> DataFrame:
    """One row: n, and whether the index is exactly 0 to n - 1."""
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return g.select("n", ((F.col("n") == 0) | ((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))).alias("contiguous"))


def gate(metrics: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Passed if any value reaches the threshold."""
    return metrics.groupBy(*by).agg(F.coalesce(F.bool_or(F.col(value) >= threshold), F.lit(False)).alias("passed"))


def streaks(rows: DataFrame, by: list[str], order: list[str], failed: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive failures: by, first, length. Gaps and islands by two row numbers."""
    all_ = Window.partitionBy(*by).orderBy(*order)
    each = Window.partitionBy(*by, "_f").orderBy(*order)
    marked = rows.withColumn("_f", failed).withColumn("_island", F.row_number().over(all_) - F.row_number().over(each))
    runs = marked.where("_f").groupBy(*by, "_island").agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("_island")


def offsets(rows: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """Adds start: the sum of the sizes before it in its batch."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def page(rows: DataFrame, key: str, seed: int, offset: int, n: int) -> DataFrame:
    """(key, step, epoch, slot): n rows from `offset` on through epochs, each in an order of its own. For many pages of one
    table keep its index and use operators.ranges.page."""
    return ranges.page(ranges.ranges(rows.select(key), [key]), seed, offset, n).select(key, "step", "epoch", "slot")


def averaged(parameters: DataFrame) -> DataFrame:
    """(name, idx, value): the mean over models of (model, name, idx, value); a parameter that a model lacks is an error."""
    models = parameters.select("model").distinct().count()
    g = parameters.groupBy("name", "idx").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    fail = F.raise_error(F.concat(F.lit("parameter missing in a model: "), F.col("name"))).cast("double")
    return g.select("name", "idx", F.when(F.col("_n") != models, fail).otherwise(F.col("value")).alias("value"))


def task_arithmetic(base: DataFrame, tuned: DataFrame, scale: float) -> DataFrame:
    """(name, idx, value): base + scale x the sum of the tuned models' differences from it."""
    sums = tuned.groupBy("name", "idx").agg(F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return base.join(sums, ["name", "idx"]).select("name", "idx", (F.col("value") + F.lit(scale) * (F.col("_s") - F.col("_n") * F.col("value"))).alias("value"))


def drops(scores: DataFrame, base: str) -> DataFrame:
    """(model, suite, difference) where a model scores below the base."""
    b = scores.where(F.col("model") == base).select("suite", F.col("score").alias("_b"))
    d = F.col("score") - F.col("_b")
    return scores.where(F.col("model") != base).join(b, "suite").where(d < 0).select("model", "suite", d.alias("difference"))


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def session_samples(log: DataFrame) -> DataFrame:
    """One row per session from records (session_id, turn, prompt_ids, output_ids, logprobs): tokens, mask, logprobs. Every
    prompt must begin with all that came before it; what it adds is masked out."""
    rows = log.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "prompt_ids", "output_ids", "logprobs"))).alias("t"))
    empty = F.struct(F.array().cast("array<int>").alias("tokens"), F.array().cast("array<int>").alias("mask"), F.array().cast("array<double>").alias("logprobs"))

    def add(acc: Column, x: Column) -> Column:
        old = F.size(acc["tokens"])
        new = F.slice(x["prompt_ids"], old + 1, F.greatest(F.size(x["prompt_ids"]) - old, F.lit(0)))
        ok = F.slice(x["prompt_ids"], 1, old) == acc["tokens"]
        fail = F.raise_error(F.lit("a prompt does not continue its session")).cast("array<int>")
        n = F.size(new)
        return F.struct(
            F.when(ok, F.concat(acc["tokens"], new, x["output_ids"])).otherwise(fail).alias("tokens"),
            F.concat(acc["mask"], F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(x["output_ids"]))).alias("mask"),
            F.concat(acc["logprobs"], F.array_repeat(F.lit(0.0), n), x["logprobs"]).alias("logprobs"),
        )

    return rows.select("session_id", F.aggregate("t", empty, add).alias("s")).select("session_id", "s.*")


def release_scan(files: DataFrame, required: list[str], forbidden: str) -> DataFrame:
    """(path, problem) from (path, text): required paths that are missing, and texts that match the forbidden pattern."""
    need = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
    missing = need.join(files.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    return missing.unionByName(files.where(F.col("text").rlike(forbidden)).select("path", F.lit("forbidden text").alias("problem")))


def rates(rows: DataFrame, by: list[str], truncated: Column, repeated: Column) -> DataFrame:
    """by, n, truncated_ratio and repetition_frac."""
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(truncated).alias("truncated_ratio"), share(repeated).alias("repetition_frac"))


def counters(rows: DataFrame, by: list[str], multimodal: Column) -> DataFrame:
    """by, total, multimodal, text_only and the percentage of all rows."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(multimodal).alias("multimodal"))
    return g.select("*", (F.col("total") - F.col("multimodal")).alias("text_only"), (100 * F.col("total") / F.sum("total").over(Window.partitionBy())).alias("percentage"))


def turn_lengths(masks: DataFrame, by: list[str], mask: str, rounds: str, cap: int) -> DataFrame:
    """by, and mean, max and min of the raw lengths and of those without observations, the share at the cap, mean rounds."""
    raw, own = F.size(mask), F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    three = lambda c, name: [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]
    return masks.groupBy(*by).agg(*three(raw, "raw"), *three(own, "own"), (F.count_if(raw >= cap) / F.count(F.lit(1))).alias("clip_ratio"), F.avg(rounds).alias("rounds_mean"))


def numbered(prompts: DataFrame, place: str, copies: int) -> DataFrame:
    """Each prompt's samples: group_index (its place, from 0), slot, and index over all samples."""
    rows = prompts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("group_index", F.col(place))
    return rows.withColumn("index", F.col("group_index") * copies + F.col("slot"))


def elapsed(log: DataFrame) -> DataFrame:
    """(timer, seconds, calls) from (timer, start, stop)."""
    return log.groupBy("timer").agg(F.sum(F.col("stop") - F.col("start")).alias("seconds"), F.count(F.lit(1)).alias("calls"))


def most_common(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Values with their number and rank: the commonest first, of equals the one seen first."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "_first"))).drop("_first")


def buffer_first(buffer: DataFrame, fresh: DataFrame, order: str, n: int) -> DataFrame:
    """n rows: those of the buffer in order, then fresh ones; `source` says which."""
    both = buffer.withColumn("source", F.lit(0)).unionByName(fresh.withColumn("source", F.lit(1)))
    return both.orderBy("source", order).limit(n)


def least_loaded_worker(workers: DataFrame, by: list[str]) -> DataFrame:
    """by, worker: the healthy one with the fewest requests, of equals the first by name."""
    healthy = workers.where("healthy").groupBy(*by).agg(F.min(F.struct("load", "worker")).alias("w"))
    return healthy.select(*by, F.col("w.worker").alias("worker"), F.col("w.load").alias("load"))


def ends(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """The first and the last floor(n x share / 2) rows of a dump, for a look at both ends."""
    half = int(rows.count() * share / 2)
    first = rows.orderBy(*order).limit(half)
    return first.unionByName(rows.orderBy(*[F.col(c).desc() for c in order]).limit(half))


def periodic(step: Column, interval: int, per_epoch: int, last: int) -> Column:
    """Whether something is due after a step (from 0): each interval, at an epoch's end, and after the last."""
    due = F.pmod(step + 1, F.lit(interval)) == 0 if interval else F.lit(False)
    return due | (F.pmod(step + 1, F.lit(per_epoch)) == 0 if per_epoch else F.lit(False)) | (step == last)


def rollout_step(rollout: Column, size: int, batch: int) -> Column:
    """The training step that a rollout begins, when each takes size / batch steps."""
    return F.expr(f"{size} div {batch}") * rollout


def restored(sent: DataFrame, results: DataFrame, at: str, index: str) -> DataFrame:
    """Results, which name their place `at` in what was sent, in the original order of `index`."""
    return sent.select(at, index).join(results, at).drop(at)


def random_reward(key: Column, seed: int) -> Column:
    """0 or 1 by hash: the same for a key in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)).cast("double")


def cells(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: every combination of the values that each key (model, cap, suite) has among the records, with the number of
    records that it has, 0 where an evaluation has still to be run. Lists of names are short; they meet in one row, unfolded key
    by key."""
    grid = records.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        grid = grid.withColumn(k, F.explode(k))
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the table's value by keys; one that the table lacks is an error."""
    fail = F.raise_error(F.concat_ws(" ", F.lit("no row for"), *[F.col(k).cast("string") for k in keys])).cast(dict(table.dtypes)[value])
    return rows.join(table.select(*keys, F.col(value).alias("_v")), keys, "left").withColumn(value, F.coalesce("_v", fail)).drop("_v")


def resumed(todo: DataFrame, cache: DataFrame, key: str, versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, left): cached results whose key is still wanted in the same versions, and what must be done again."""
    same = [key, *versions]
    kept = cache.dropDuplicates(same).join(todo.select(*same), same, "left_semi")
    return kept, todo.join(kept.select(*same), same, "left_anti")


def rescored(dump: DataFrame, reward: Column) -> DataFrame:
    """A stored rollout with another reward, and by how much it differs from the stored one."""
    return dump.withColumn("new_reward", reward).withColumn("difference", F.col("new_reward") - F.col("reward"))


def eval_log(samples: DataFrame, datasets: str, key: str) -> DataFrame:
    """For each dataset: problems, samples, mean reward, truncated ratio, and pass rate of the best sample."""
    per = samples.groupBy(datasets, key).agg(F.count(F.lit(1)).alias("_n"), F.avg("reward").alias("_r"), F.max("reward").alias("_best"), F.count_if(F.col("status") == "truncated").alias("_t"))
    return per.groupBy(datasets).agg(F.count(F.lit(1)).alias("problems"), F.sum("_n").alias("samples"), (F.sum(F.col("_r") * F.col("_n")) / F.sum("_n")).alias("mean_reward"), (F.sum("_t") / F.sum("_n")).alias("truncated_ratio"), F.avg("_best").alias("best_reward"))
