"""Evaluation records: question scores, macro levels, pairs, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The published intervals come from these.
REPLICATES, SEED = 10_000, 20_260_923


def question_scores(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, score: the share of '1' in `correct`. An id that occurs twice under the same keys is an error."""
    score = F.try_divide(F.length("correct") - F.length(F.replace(F.col("correct"), F.lit("1"), F.lit(""))), F.length("correct"))
    g = records.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("score"))
    fail = F.raise_error(F.concat(F.lit("duplicate question id "), F.col("id"))).cast("double")
    return g.select(*keys, "id", F.when(F.col("_n") > 1, fail).otherwise(F.col("score")).alias("score"))


def levels(scores: DataFrame, domains: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """keys, a column per suite (100 x the mean over questions), per domain and total: means of suites, null if one is
    missing."""
    suites = [s for v in domains.values() for s in v]
    one = scores.groupBy(*keys).agg(*[(100 * F.avg(F.when(F.col("suite") == s, F.col("score")))).alias(s) for s in suites])

    def mean(names: list[str]) -> Column:
        total = F.lit(0.0)
        for s in names:  # A null makes the sum null.
            total = total + F.col(s)
        return total / len(names)

    return one.select("*", *[mean(v).alias(d) for d, v in domains.items()], mean(suites).alias("total"))


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """suite, id, sa, sb of two models; an id that one lacks is an error."""
    one = scores.where(F.col("model") == a).select("suite", "id", F.col("score").alias("sa"))
    two = scores.where(F.col("model") == b).select("suite", "id", F.col("score").alias("sb"))
    fail = F.raise_error(F.concat(F.lit("question of one model only: "), F.col("id"))).cast(dict(scores.dtypes)["score"])
    both = one.join(two, ["suite", "id"], "full")
    return both.select("suite", "id", *[F.when(F.col("sa").isNull() | F.col("sb").isNull(), fail).otherwise(F.col(c)).alias(c) for c in ("sa", "sb")])


def contrast_points(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, delta: the mean over suites of 100 x the mean difference."""
    per = pairs.groupBy(*keys, "suite").agg((100 * (F.avg("sa") - F.avg("sb"))).alias("d"))
    return per.groupBy(*keys).agg(F.avg("d").alias("delta"), F.count(F.lit(1)).alias("suites"))


def distribution(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, median, extremes and percentiles with linear interpolation. Values are counted first: what meets at a key is
    its distinct values with their counts."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    p = lambda q: F.percentile(value, q, F.col("_n"))
    mean = F.sum(F.when(F.col(value).isNotNull(), F.col(value) * F.col("_n"))) / F.sum(F.when(F.col(value).isNotNull(), F.col("_n")))
    return counts.groupBy(*keys).agg(mean.alias("mean"), p(0.5).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"), *[p(q / 100).alias(f"p{q}") for q in (25, 75, 90, 95, 99)])


def nearest_rank(df: DataFrame, value: str, keys: list[str], share: float) -> DataFrame:
    """The value at place floor(n x share), from 0, in order: an exact percentile that is one of the values. Values are
    counted first, so a key's task orders its distinct values, not its rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    upto = F.sum("_n").over(every.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = counts.select(*keys, value, "_n", upto.alias("_upto"), F.floor(F.sum("_n").over(every) * F.lit(share)).alias("_at"))
    return at.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, F.col(value).alias("rank_value"))


def bucket_shares(df: DataFrame, value: str, n: int) -> DataFrame:
    """(bucket, share) over n equal parts of the range up to the maximum."""
    top = df.agg(F.max(value).alias("_top"), F.count(F.lit(1)).alias("_all"))
    place = F.greatest(F.lit(1), F.ceil(F.col(value) * n / F.col("_top")))
    found = df.crossJoin(F.broadcast(top)).select(place.cast("long").alias("bucket"), "_all")
    return found.groupBy("bucket").agg((F.count(F.lit(1)) / (F.max("_all") + 1e-9)).alias("share"))


def matched(rows: DataFrame, catalogue: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns of a catalogue that must have exactly the same keys; a key that one side lacks is an error."""
    both = rows.withColumn("_a", F.lit(1)).join(catalogue.select(*keys, *columns, F.lit(1).alias("_b")), keys, "full")
    fail = F.raise_error(F.concat_ws(" ", F.lit("not in both:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return both.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), fail).otherwise(True)).drop("_a", "_b")


def cell_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problems, samples, mean_pass1, mean_output_tokens and cap_hit_rate of question records (correct, mean_tokens,
    cap_hits, n): the mean of questions' shares, and means over all samples."""
    share = F.try_divide(F.length("correct") - F.length(F.replace(F.col("correct"), F.lit("1"), F.lit(""))), F.length("correct"))
    over = lambda c: F.try_divide(F.sum(c), F.sum("n"))
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("problems"), F.sum("n").alias("samples"), F.avg(share).alias("mean_pass1"), over(F.col("mean_tokens") * F.col("n")).alias("mean_output_tokens"), over(F.col("cap_hits")).alias("cap_hit_rate"))


def checked_cells(cells: DataFrame, recorded: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Cells, each with whether it agrees with the recorded summary (problems, mean_pass1); null where none is recorded."""
    known = recorded.select(*keys, F.col("problems").alias("_p"), F.col("mean_pass1").alias("_m"))
    agrees = (F.col("problems") == F.col("_p")) & (F.abs(F.col("mean_pass1") - F.col("_m")) <= tolerance)
    return cells.join(known, keys, "left").withColumn("agrees", agrees).drop("_p", "_m")


def level_tokens(cells: DataFrame, domains: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """keys, a column of mean output tokens for each domain, and cap_hit_rate, the mean over all suites; null where one of
    the suites is missing. `cells` has a row for each suite."""
    suites = [s for v in domains.values() for s in v]
    mean = lambda c, names: F.when(F.count_if(F.col("suite").isin(names)) == len(names), F.avg(F.when(F.col("suite").isin(names), F.col(c))))
    return cells.groupBy(*keys).agg(*[mean("mean_output_tokens", v).alias(f"{d}_tokens") for d, v in domains.items()], mean("cap_hit_rate", suites).alias("cap_hit_rate"))


def published_check(found: DataFrame, published: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys, field, deviation and ok for every published cell; one that was not recomputed is not ok."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])).alias("_c")).select(*keys, "_c.*")
    both = long(published, "_want").where("_want is not null").join(long(found, "_have"), [*keys, "field"], "left")
    gap = F.abs(F.col("_have") - F.col("_want"))
    return both.select(*keys, "field", gap.alias("deviation"), F.coalesce(gap <= tolerance, F.lit(False)).alias("ok"))


def score_without(scores: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score over all questions, and score_without those listed (keys, id), with how many were left out."""
    marked = scores.join(listed.select(*keys, "id", F.lit(1).alias("_out")).distinct(), [*keys, "id"], "left")
    return marked.groupBy(*keys).agg(F.avg("score").alias("score"), F.avg(F.when(F.col("_out").isNull(), F.col("score"))).alias("score_without"), F.count("_out").alias("left_out"))


def graded(rows: DataFrame, catalogue: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """From generated rows (keys, id, input_sha256, responses, token_counts, finish_reasons) and a catalogue (id,
    input_sha256, answer): question records, and their cells' summary. A response is right if it holds the answer as its
    last word."""
    met = matched(rows, catalogue, ["id", "input_sha256"], ["answer"])
    last = lambda r: F.regexp_extract(r, r"(\S+)\s*\z", 1)
    right = F.transform("responses", lambda r: F.when(last(r) == F.col("answer"), F.lit("1")).otherwise(F.lit("0")))
    n = F.size("responses")
    mean = F.aggregate("token_counts", F.lit(0.0), lambda a, x: a + x) / n
    hits = F.size(F.filter("finish_reasons", lambda x: x == "length"))
    records = met.select(*keys, "id", "input_sha256", n.alias("n"), F.array_join(right, "").alias("correct"), mean.alias("mean_tokens"), hits.alias("cap_hits"))
    return records, cell_summary(records, keys)
