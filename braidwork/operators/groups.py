"""Groups of sampled responses: filters, balance, normalisation, pass@k, margins, injection, switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import ranges
from braidwork.operators.partitioning import sized

GROUP = "group_index"
#: Places to which gaps, and gains by which samples are put in order, are told apart: beyond, sums of doubles depend on their
#: order.
PLACES, FINE_PLACES = 9, 12


def normalised(rows: DataFrame, by_std: bool = True) -> DataFrame:
    """Adds advantage: reward minus the group's mean, over its sample deviation + 1e-6; groups by their column, whatever
    their size. Groups of one have no deviation and get null."""
    w = Window.partitionBy(GROUP)
    centred = F.col("reward") - F.avg("reward").over(w)
    return rows.withColumn("advantage", centred / (F.stddev_samp("reward").over(w) + 1e-6) if by_std else centred)


def varied(rows: DataFrame, least: float = 1e-8) -> DataFrame:
    """One row per group: keep if the rewards' sample deviation exceeds `least`, and its first reward (by slot)."""
    g = rows.groupBy(GROUP).agg(F.stddev_samp("reward").alias("sd"), F.min_by("reward", "slot").alias("first_reward"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("keep", F.coalesce(F.col("sd") > least, F.lit(False)))


def bounded_filter(groups: DataFrame, budget: int) -> DataFrame:
    """Adds accept: kept by its variance, or past the budget.

    The place is needed only up to the budget, so the order needs one task over `budget` rows and no more.
    """
    first = groups.orderBy(GROUP).limit(budget).select(F.max(GROUP).over(Window.partitionBy()).alias("edge")).limit(1)
    edge = first.agg(F.max("edge").alias("edge"))
    return groups.crossJoin(F.broadcast(edge)).withColumn("accept", (F.col(GROUP) > F.col("edge")) | F.col("keep")).drop("edge")


def zero_std_counts(rows: DataFrame) -> DataFrame:
    """(reward, groups): groups of more than one whose rewards are all equal, by that reward."""
    g = rows.groupBy(GROUP).agg(F.min("reward").alias("lo"), F.max("reward").alias("hi"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1 and lo = hi").groupBy(F.col("lo").alias("reward")).agg(F.count(F.lit(1)).alias("groups"))


def without_aborted(rows: DataFrame) -> DataFrame:
    aborted = rows.groupBy(GROUP).agg(F.max((F.col("status") == "aborted").cast("int")).alias("_a")).where("_a = 1").select(GROUP)
    return rows.join(aborted, GROUP, "left_anti")


def balanced(rows: DataFrame, ratio: float, by_group: bool = True, seed: int = 0) -> DataFrame:
    """Adds keep: correct to incorrect rows at most ratio to 1 (the majority thinned in the order of a hash, to at least
    one); 0 keeps only incorrect, infinity only correct, and none where a side is empty. A null verdict is incorrect."""
    ok = F.coalesce(F.col("correct"), F.lit(False))
    keys = [GROUP] if by_group else []
    sums = {"_c": F.sum(ok.cast("long")), "_i": F.sum((~ok).cast("long"))}
    if keys:
        own = Window.partitionBy(*keys)
        joined = sized(rows, keys).withColumns({name: c.over(own) for name, c in sums.items()})
    else:
        joined = rows.crossJoin(F.broadcast(rows.agg(*[c.alias(name) for name, c in sums.items()])))
    joined = joined.withColumn("_ok", ok)
    if ratio == 0 or ratio == float("inf"):
        return joined.withColumn("keep", ~F.col("_ok") if ratio == 0 else F.col("_ok")).drop("_c", "_i", "_ok")
    cap_c, cap_i = F.greatest(F.lit(1), F.floor(F.col("_i") * ratio)), F.greatest(F.lit(1), F.floor(F.col("_c") / ratio))
    order = Window.partitionBy(*keys, "_ok").orderBy(F.xxhash64(F.lit(seed), GROUP, "slot"), GROUP, "slot")
    rank = F.row_number().over(order)
    most = F.when(F.col("_ok"), F.when(F.col("_c") > F.col("_i") * ratio, cap_c).otherwise(F.col("_c"))).otherwise(F.when(F.col("_c") < F.col("_i") * ratio, cap_i).otherwise(F.col("_i")))
    keep = (F.col("_c") > 0) & (F.col("_i") > 0) & (rank <= most)
    return joined.withColumn("keep", keep).drop("_c", "_i", "_ok")


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - prod over i from n-c+1 to n of (1 - k/i); 1 where n - c < k, 0 without successes."""
    product = F.aggregate(F.sequence(n - c + 1, F.greatest(n, n - c + 1)), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - product)


def pass_rates(rows: DataFrame) -> DataFrame:
    """(k, pass_rate) for k = 1, 2, 4, ... up to the group size, as means over groups; success is reward = 1."""
    g = rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("reward") == 1).cast("long")).alias("c"))
    ks = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("n").cast("double"))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("long"))
    g = g.where("n > 1").select("n", "c", F.explode(ks).alias("k"))
    return g.groupBy("k").agg(F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_rate"), F.count(F.lit(1)).alias("groups"))


def margin_shift(rows: DataFrame, delta: float, by_group: bool = False, kind: str = "mean", direction: str = "correct_up") -> DataFrame:
    """(scope, gap, shift): where the correct samples' mean (or least) exceeds the incorrect ones' mean (or greatest) by
    less than delta, what lifts it to delta; the direction says which side moves and is honoured in every scope."""
    keys = [GROUP] if by_group else []
    ok, no = F.when(F.col("correct"), F.col("reward")), F.when(~F.coalesce(F.col("correct"), F.lit(False)), F.col("reward"))
    up, down = (F.avg(ok), F.avg(no)) if kind == "mean" else (F.min(ok), F.max(no))
    g = rows.groupBy(*keys).agg(up.alias("cor"), down.alias("inc")).where("cor is not null and inc is not null")
    gap = F.col("cor") - F.col("inc")
    sign = 1 if direction == "correct_up" else -1
    return g.select(*keys, gap.alias("gap"), F.when(gap < delta, sign * (F.col("inc") - F.col("cor") + delta)).otherwise(0.0).alias("shift"))


def _orders(kind: str) -> None:
    if kind not in ("mean", "minmax"):
        raise ValueError("a gap is of mean or minmax")


def greedy_margin_mask(rows: DataFrame, delta: float, least: float = 0.5, kind: str = "mean") -> DataFrame:
    """(group_index, slot, masked): per group, the worst correct or the best incorrect sample is taken out again and again,
    whichever widens the gap more (ties: correct), until the gap is delta, nothing helps, or `least` of a side is left. The gap
    is that of means, or with minmax of the least correct and greatest incorrect one. A null verdict is incorrect; a sample
    without reward neither counts nor goes.

    No loop is needed. What taking out a side's next sample gains depends on that side alone. Of two lists of gains of which
    always the greater head is taken, the order is that of their running minima; and as only gains above 0 are taken, the gap
    grows along it, so a sample goes if the gap before it is below delta."""
    _orders(kind)
    correct = F.coalesce(F.col("correct"), F.lit(False))
    at = rows.select(GROUP, "slot", (~correct).cast("int").alias("_side"), F.when(correct, F.col("reward")).otherwise(-F.col("reward")).alias("_v"))
    at = sized(at, [GROUP])
    side = Window.partitionBy(GROUP, "_side")
    order = side.orderBy(F.col("_v").asc_nulls_last(), "slot")
    n, i = F.count("_v").over(side), F.row_number().over(order) - 1
    left = F.sum("_v").over(order.rowsBetween(0, Window.unboundedFollowing))
    at = at.withColumns({"_n": n, "_i": i, "_left": left, "_next": F.lead("_v").over(order)})
    at = _gained(at, kind, least)
    at = at.withColumn("_key", F.min(F.round("_gain", FINE_PLACES)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # One side's gap is its first row's; both sides must have one.
    firsts = F.sum(F.when(F.col("_i") == 0, F.col("_gap"))).over(Window.partitionBy(GROUP))
    sides = F.count(F.when((F.col("_i") == 0) & F.col("_v").isNotNull(), 1)).over(Window.partitionBy(GROUP))
    merged = Window.partitionBy(GROUP).orderBy(F.col("_key").desc_nulls_last(), "_side", "_i").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({"_gap0": firsts, "_sides": sides, "_before": F.coalesce(F.sum("_gain").over(merged), F.lit(0.0))})
    masked = (F.col("_sides") == 2) & F.col("_gain").isNotNull() & (F.col("_key") > 0) & (F.round(F.col("_gap0") + F.col("_before"), PLACES) < delta)
    return at.select(GROUP, "slot", F.coalesce(masked, F.lit(False)).alias("masked"))


def _gained(at: DataFrame, kind: str, least: float) -> DataFrame:
    """Adds _gap, a side's share in the gap as its row finds it, and _gain by taking the row out (null where it must stay), from
    the place _i among _n, the sum _left from it on and the value _next after it."""
    stay = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(least)))
    rest = F.col("_n") - F.col("_i")
    gap = F.col("_left") / rest if kind == "mean" else F.col("_v")
    after = (F.col("_left") - F.col("_v")) / (rest - 1) if kind == "mean" else F.col("_next")
    return at.withColumn("_gap", F.when(F.col("_v").isNotNull(), gap)).withColumn("_gain", F.when(F.col("_v").isNotNull() & (F.col("_i") < F.col("_n") - stay), after - gap))


def global_margin_mask(rows: DataFrame, delta: float, least: float = 0.5, kind: str = "mean") -> DataFrame:
    """As greedy_margin_mask with all rows as one group. Both sides' orders and the order of gains are indexes of ranges: sums and
    minima run within a range, and go on from one value for each range before it, so no task has all rows."""
    _orders(kind)
    correct = F.coalesce(F.col("correct"), F.lit(False))
    at = rows.select(F.col(GROUP).cast("long").alias(GROUP), F.col("slot").cast("int").alias("slot"), (~correct).cast("int").alias("_side"), F.when(correct, F.col("reward")).otherwise(-F.col("reward")).alias("_v"))
    sizes = {r["_side"]: r for r in at.groupBy("_side").agg(F.count("_v").alias("n"), F.sum("_v").alias("s"), F.min("_v").alias("least")).collect()}  # two rows
    none = at.select(GROUP, "slot", F.lit(False).alias("masked"))
    if len(sizes) < 2 or not all(r.n for r in sizes.values()):
        return none
    n0, n1, s0, s1 = sizes[0].n, sizes[1].n, sizes[0].s, sizes[1].s
    index = ranges.ranges(at.where("_v is not null"), ["_side", "_v", GROUP, "slot"])
    one = F.col("_side") == 0
    placed = index.running({"_sum": ("sum", F.col("_v"))}, follow={"_next": F.struct("_side", "_v")})
    placed = placed.withColumns({"_n": F.when(one, n0).otherwise(n1), "_i": F.when(one, F.col("place")).otherwise(F.col("place") - n0)})
    placed = placed.withColumn("_left", F.when(one, F.lit(s0) - F.col("_sum")).otherwise(F.lit(s0 + s1) - F.col("_sum")))
    placed = placed.withColumn("_next", F.when(F.col("_next")["_side"] == F.col("_side"), F.col("_next")["_v"]))
    gains = _gained(placed, kind, least)
    gap0 = s0 / n0 + s1 / n1 if kind == "mean" else sizes[0].least + sizes[1].least
    # The least gain up to a row, of its own side: of the other side's rows nothing is carried on.
    keyed = index.running({f"_least{k}": ("min", F.when(F.col("_side") == k, F.round("_gain", FINE_PLACES))) for k in (0, 1)}, of=gains)
    key = F.least(F.round("_gain", FINE_PLACES), F.when(one, F.col("_least0")).otherwise(F.col("_least1")))
    worth = keyed.where(F.col("_gain").isNotNull()).withColumn("_key", key).where("_key > 0").select(GROUP, "slot", "_side", "_i", "_gain", (-F.col("_key")).alias("_order"))
    merged = ranges.ranges(worth, ["_order", "_side", "_i"])
    gone = merged.running({"_before": ("sum", F.col("_gain"))}).where(F.round(F.lit(gap0) + F.col("_before"), PLACES) < delta)
    marks = gone.select(GROUP, "slot", F.lit(True).alias("_gone"))
    return at.select(GROUP, "slot").join(marks, [GROUP, "slot"], "left").select(GROUP, "slot", F.coalesce("_gone", F.lit(False)).alias("masked"))


def injection_pick(rows: DataFrame) -> DataFrame:
    """Per group the sample to replace: the first wrong one, else the first."""
    order = Window.partitionBy(GROUP).orderBy(F.coalesce(F.col("correct"), F.lit(False)), "slot")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(GROUP, "slot", F.coalesce(F.col("correct"), F.lit(False)).alias("correct"))


def annealed(start: float, over: Column | float, step: Column) -> Column:
    return F.lit(start) * F.greatest(F.lit(0.0), 1 - step / over)


def switches(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds previous, is_repeat, switched."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("previous", before).withColumn("is_repeat", before.isNotNull()).withColumn("switched", before.isNotNull() & (before != F.col(value)))


def argmin_teacher(scores: DataFrame, by: list[str]) -> DataFrame:
    """The teacher with the least mean score, the first by name in ties; a score that is not finite is an error."""
    bad = F.isnan("score") | (F.abs("score") == float("inf"))
    score = F.when(bad, F.raise_error(F.lit("non-finite score")).cast("double")).otherwise(F.col("score"))
    means = scores.groupBy(*by, "teacher").agg(F.avg(score).alias("mean"))
    return means.groupBy(*by).agg(F.min(F.struct("mean", "teacher")).alias("m")).select(*by, F.col("m.teacher").alias("teacher"), F.col("m.mean").alias("mean"))


def routed(rows: DataFrame, alias: Column, table: dict[str, str], default: str, known: set[str]) -> DataFrame:
    """Adds teacher: none, '' and 'default' give the default, an alias its teacher, other names themselves if known; others
    are an error."""
    pairs = F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v))])
    name = F.when(alias.isNull() | alias.isin("", "default"), F.lit(default)).otherwise(F.coalesce(F.try_element_at(pairs, alias), alias))
    fail = F.raise_error(F.concat(F.lit("unregistered teacher "), name))
    return rows.withColumn("teacher", F.when(name.isin(*known), name).otherwise(fail))


def trimmed(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first floor(n / size) x size rows by `order`; of rows equal in it those go whose hash over all columns is least, so the
    same on any run. Fewer than `size` rows are cut, so only those are ordered in one task."""
    extra = rows.count() % size
    if not extra:
        return rows
    last = rows.select(*order).orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(extra)
    cut = last.groupBy(*order).agg(F.count(F.lit(1)).alias("_cut")).select(F.struct(*order).alias("_key"), "_cut")  # fewer rows than `size`
    met = rows.withColumn("_order", F.struct(*order)).join(F.broadcast(cut), F.col("_order").eqNullSafe(F.col("_key")), "left")
    whole = met.where("_cut is null").drop("_order", "_key", "_cut")
    # Only rows that tie with one that goes are numbered, each tie by itself.
    tied = met.where("_cut is not null").withColumn("_r", F.row_number().over(Window.partitionBy("_order").orderBy(F.xxhash64(*rows.columns), *rows.columns)))
    return whole.unionByName(tied.where("_r > _cut").drop("_order", "_key", "_cut", "_r"))


def keep_cascade(rows: DataFrame) -> DataFrame:
    """Adds reason: the first that applies of truncated, prompt_ids_mismatch, verifier_none and wrong; null if kept."""
    why = F.when(F.col("finish_reason") == "length", "truncated").when(~F.col("prompt_ids_match"), "prompt_ids_mismatch").when(F.col("correct").isNull(), "verifier_none").when(~F.col("correct"), "wrong")
    return rows.withColumn("reason", why)

