"""Registered queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.functions import answers, text
from braidwork.operators import evaluation as ev
from braidwork.operators import groups as gr
from braidwork.operators import intervals as iv
from braidwork.operators import normalizer as nz
from braidwork.operators import partitioning as pt
from braidwork.operators import prompts as pr
from braidwork.operators import rollouts as ro
from braidwork.operators import tokens as tk
from braidwork.plans.views import WITH, groups, records, responses, table, tokens
from braidwork.sources.readers import Part, mixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (WITH if views else "") + sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


STATS = "SELECT domain, count(DISTINCT sample_id) responses, count(*) FILTER (mask) tokens, coalesce(sum(r) FILTER (mask), 0) s, coalesce(sum(r*r) FILTER (mask), 0) q FROM tokens GROUP BY domain"
STD = "CASE WHEN {n} < 2 OR {q}/{n} - ({s}/{n})*({s}/{n}) <= 1e-12*{q}/{n} THEN 0 ELSE sqrt({q}/{n} - ({s}/{n})*({s}/{n})) END"
MULT = f"""SELECT domain, responses, tokens, {STD.format(n="tokens", s="s", q="q")} sd, {STD.format(n="sum(tokens) OVER ()", s="sum(s) OVER ()", q="sum(q) OVER ()")} sd_all FROM ({STATS})"""
CLIP = "least(4.0, greatest(0.25, CASE WHEN sd > 0 AND sd_all > 0 THEN sd_all / sd ELSE 1 END))"


@query(f"SELECT domain, responses, tokens, round(s, 6) s, round(q, 6) q FROM ({STATS})")
def dn_sufficient_stats(spark, d):
    return nz.sufficient_stats(tokens(spark, d)).select("domain", "responses", "tokens", r6("s"), r6("q"))


@query(f"SELECT domain, responses, tokens, round(sd, 6) sd, round(sd_all, 6) sd_all, round({CLIP}, 6) multiplier, {CLIP} <> sd_all / sd clipped FROM ({MULT})")
def dn_multipliers(spark, d):
    m = nz.multipliers(nz.sufficient_stats(tokens(spark, d)))
    return m.select("domain", "responses", "tokens", r6("sd"), r6("sd_all"), r6("multiplier"), "clipped")


@query(f"SELECT t.sample_id, t.pos, round(t.adv * m.w, 6) adv FROM tokens t JOIN (SELECT domain, {CLIP} w FROM ({MULT})) m USING (domain)")
def dn_scaled_advantages(spark, d):
    t = tokens(spark, d)
    return nz.scaled(t, nz.multipliers(nz.sufficient_stats(t))).select("sample_id", "pos", r6("adv"))


@query("SELECT domain, 1.0::DOUBLE observed, CASE domain WHEN 'click' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 1.25 END::DOUBLE fixed FROM tokens GROUP BY domain")
def dn_modes_observe_fixed(spark, d):
    m = nz.multipliers(nz.sufficient_stats(tokens(spark, d)))
    constants = {"click": 0.5, "view": 2.0, "error": 1.25, "purchase": 1.25, "signup": 1.25}
    both = nz.applied(nz.applied(m, "observe").withColumnRenamed("applied", "observed"), "fixed", constants)
    return both.select("domain", "observed", F.col("applied").alias("fixed"))


BY_DAY = f"""SELECT step, domain, sd, sd_all, {CLIP} w FROM (SELECT step, domain, {STD.format(n="n", s="s", q="q")} sd, {STD.format(n="sum(n) OVER (PARTITION BY step)", s="sum(s) OVER (PARTITION BY step)", q="sum(q) OVER (PARTITION BY step)")} sd_all
 FROM (SELECT step, domain, count(*) FILTER (mask) n, coalesce(sum(r) FILTER (mask), 0) s, coalesce(sum(r*r) FILTER (mask), 0) q FROM tokens GROUP BY step, domain))"""


@query(f"SELECT step, domain, round(w, 6) measured, round(coalesce(first_value(CASE WHEN sd > 0 AND sd_all > 0 THEN w END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY step ROWS UNBOUNDED PRECEDING), w), 6) applied FROM ({BY_DAY})")
def dn_frozen_by_day(spark, d):
    m = F.col("mask")
    stats = tokens(spark, d).groupBy("step", "domain").agg(F.count(F.when(m, 1)).alias("tokens"), F.coalesce(F.sum(F.when(m, F.col("r"))), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(m, F.col("r") * F.col("r"))), F.lit(0.0)).alias("q"))
    return nz.frozen(nz.multipliers_by(stats, "step")).select("step", "domain", r6("multiplier", "measured"), r6("applied"))


@query("SELECT domain, count(*) responses, sum(n)::BIGINT tokens, round(sum(s), 6) s, round(sum(q), 6) q FROM (SELECT domain, sample_id, sample_id % 3, count(*) FILTER (mask) n, coalesce(sum(r) FILTER (mask), 0) s, coalesce(sum(r*r) FILTER (mask), 0) q FROM tokens GROUP BY ALL) GROUP BY domain")
def merge_stats_partials(spark, d):
    t = tokens(spark, d)
    parts = [nz.sufficient_stats(t.where(F.col("sample_id") % 3 == i)) for i in range(3)]
    return nz.merge_stats(*parts).select("domain", "responses", "tokens", r6("s"), r6("q"))


RATIO = "exp(s_lp - old_lp)"


@query(f"SELECT responses, round(sum_of_means, 6) sum_of_means, round(mean_of_means, 6) mean_of_means FROM (SELECT count(*) responses, sum(m) sum_of_means, avg(m) mean_of_means FROM (SELECT sample_id, sum(CASE WHEN mask THEN -least({RATIO}*adv, least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE)*adv) ELSE 0 END)/greatest(count(*) FILTER (mask), 1) m FROM tokens GROUP BY 1))")
def clipped_surrogate(spark, d):
    t = tokens(spark, d).withColumn("loss", tk.clipped_surrogate(F.exp(F.col("s_lp") - F.col("old_lp")), F.col("adv"), 0.2))
    return tk.sample_mean_loss(t, "loss", ["sample_id"]).select("responses", r6("sum_of_means"), r6("mean_of_means"))


PL = f"greatest(-{RATIO}*adv, -least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE)*adv)"


@query(f"SELECT domain, round(avg(CASE WHEN adv < 0 THEN least(-3*adv, {PL}) ELSE {PL} END), 6) loss, round(avg(CASE WHEN -least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE)*adv > -{RATIO}*adv THEN 1.0::DOUBLE ELSE 0 END), 6) clipfrac FROM tokens WHERE mask GROUP BY domain")
def policy_loss_dual_clip(spark, d):
    loss, clip = tk.policy_loss(F.exp(F.col("s_lp") - F.col("old_lp")), F.col("adv"), 0.2, 0.2, 3.0)
    return tokens(spark, d).where("mask").groupBy("domain").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(clip), 6).alias("clipfrac"))


@query("SELECT domain, round(avg(s_lp - t_lp), 6) k1, round(avg((s_lp-t_lp)*(s_lp-t_lp)/2), 6) k2, round(avg(exp(t_lp-s_lp) - 1 + s_lp - t_lp), 6) k3, round(avg(least(greatest(exp(t_lp-s_lp) - 1 + s_lp - t_lp, -10::DOUBLE), 10::DOUBLE)), 6) low_var FROM tokens WHERE mask GROUP BY domain")
def kl_estimators(spark, d):
    kl = lambda k: F.round(F.avg(tk.approx_kl(F.col("s_lp"), F.col("t_lp"), k)), 6)
    return tokens(spark, d).where("mask").groupBy("domain").agg(kl("k1").alias("k1"), kl("k2").alias("k2"), kl("k3").alias("k3"), kl("low_var_kl").alias("low_var"))


@query("SELECT domain, round(avg(least(greatest(exp(s_lp-old_lp), 0::DOUBLE), 2::DOUBLE)), 6) tis, round(avg(CASE WHEN exp(s_lp-old_lp) > 2 THEN 1::DOUBLE ELSE 0 END), 6) clipfrac, round(avg(CASE WHEN exp(s_lp-old_lp) BETWEEN 0.5 AND 2 THEN exp(s_lp-old_lp) ELSE 0 END), 6) icepop FROM tokens GROUP BY domain")
def tis_icepop(spark, d):
    w, clip = tk.truncated_is(F.col("s_lp"), F.col("old_lp"))
    return tokens(spark, d).groupBy("domain").agg(F.round(F.avg(w), 6).alias("tis"), F.round(F.avg(clip), 6).alias("clipfrac"), F.round(F.avg(tk.ice_pop(F.col("s_lp"), F.col("old_lp"))), 6).alias("icepop"))


@query("SELECT sample_id, pos, round((adv - (SELECT avg(adv) FROM tokens WHERE mask)) / sqrt((SELECT var_samp(adv) FROM tokens WHERE mask) + 1e-8), 5) white FROM tokens")
def masked_whiten(spark, d):
    return tk.whiten(tokens(spark, d), "adv", "white").select("sample_id", "pos", F.round("white", 5).alias("white"))


@query("SELECT responses, round(a, 6) sum_of_means, round(b, 6) token_sum FROM (SELECT count(*) responses, sum(s/greatest(n,1)) a, sum(s) b FROM (SELECT sample_id, coalesce(sum(adv) FILTER (mask), 0) s, count(*) FILTER (mask) n FROM tokens GROUP BY 1))")
def sample_mean_reduction(spark, d):
    return tk.sample_mean_loss(tokens(spark, d), "adv", ["sample_id"]).select("responses", r6("sum_of_means"), r6("token_sum"))


SERIES = "SELECT sample_id, list(CASE WHEN mask THEN r ELSE 0 END ORDER BY pos) v, list(s_lp ORDER BY pos) u FROM tokens GROUP BY 1"


def _series(spark, d):
    rows = tokens(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("mask"), F.col("r")).otherwise(0.0).alias("r"), "s_lp"))).alias("t"))
    return rows.select("sample_id", F.col("t.r").alias("v"), F.col("t.s_lp").alias("u"))


@query(f"SELECT sample_id, len(v)::INT n, round(list_reduce(list_prepend(0::DOUBLE, list_reverse(v)), lambda a, x: x + 0.9::DOUBLE*a), 6) first_return FROM ({SERIES})")
def discounted_returns(spark, d):
    g = tk.discounted(F.col("v"), 0.9)
    return _series(spark, d).select("sample_id", F.size("v").alias("n"), F.round(F.get(g, F.lit(0)), 6).alias("first_return"))


@query(f"SELECT sample_id, round(list_reduce(list_prepend(0::DOUBLE, list_reverse(list_transform(v, lambda x, i: x + 0.9::DOUBLE*coalesce(u[i+1], 0) - u[i]))), lambda a, x: x + 0.9::DOUBLE*0.8::DOUBLE*a), 6) first_advantage FROM ({SERIES})")
def gae(spark, d):
    a = F.get(tk.gae(F.col("v"), F.col("u"), 0.9, 0.8), F.lit(0))
    return _series(spark, d).select("sample_id", F.round(a["a"], 6).alias("first_advantage"))


@query("SELECT keep, count(*) n FROM (SELECT CASE WHEN adv < 0 AND sum(CASE WHEN mask THEN old_lp - s_lp ELSE 0 END) OVER w / greatest(count(*) FILTER (mask) OVER w, 1) > 0.0001 THEN 0 ELSE 1 END keep FROM tokens WINDOW w AS (PARTITION BY sample_id)) GROUP BY keep")
def opsm_mask(spark, d):
    return tk.opsm(tokens(spark, d), ["sample_id"]).groupBy("keep").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT domain, round(avg(greatest((s_lp-adv)*(s_lp-adv), (k-adv)*(k-adv))), 6) loss FROM (SELECT *, old_lp + least(greatest(s_lp-old_lp, -0.2::DOUBLE), 0.2::DOUBLE) k FROM tokens) GROUP BY domain")
def value_loss_clipped(spark, d):
    loss, _ = tk.value_loss(F.col("s_lp"), F.col("old_lp"), F.col("adv"))
    return tokens(spark, d).groupBy("domain").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("SELECT sample_id, pos, round(ln((exp(t_lp) + exp(s_lp) + exp(old_lp)) / 3), 6) pooled FROM tokens")
def teacher_pool_logsumexp(spark, d):
    return tokens(spark, d).select("sample_id", "pos", F.round(tk.log_mean_exp(F.array("t_lp", "s_lp", "old_lp")), 6).alias("pooled"))


@query("SELECT group_index, slot, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-6), 6) advantage FROM grp WINDOW w AS (PARTITION BY group_index)")
def grpo_group_norm(spark, d):
    return gr.normalised(groups(spark, d)).select("group_index", "slot", r6("advantage"))


@query("SELECT reward, count(*) groups FROM (SELECT min(reward) reward FROM grp GROUP BY group_index HAVING count(*) > 1 AND min(reward) = max(reward)) GROUP BY reward")
def zero_std_groups(spark, d):
    return gr.zero_std_counts(groups(spark, d))


@query("SELECT group_index, coalesce(stddev_samp(reward) > 1e-8, false) OR row_number() OVER (ORDER BY group_index) > 500 accept FROM grp GROUP BY group_index")
def bounded_filter(spark, d):
    return gr.bounded_filter(gr.varied(groups(spark, d)), 500).select("group_index", "accept")


@query("SELECT group_index, slot FROM grp WHERE group_index NOT IN (SELECT group_index FROM grp WHERE status = 'aborted')")
def aborted_groups(spark, d):
    return gr.without_aborted(groups(spark, d)).select("group_index", "slot")


@query("SELECT group_index, CASE WHEN c = 0 OR i = 0 THEN 0 WHEN c > i THEN greatest(1, i) ELSE c END::BIGINT kept_correct, CASE WHEN c = 0 OR i = 0 THEN 0 WHEN c < i THEN greatest(1, c) ELSE i END::BIGINT kept_incorrect FROM (SELECT group_index, count(*) FILTER (correct) c, count(*) FILTER (NOT correct) i FROM grp GROUP BY 1)")
def balance_counts(spark, d):
    b = gr.balanced(groups(spark, d), 1.0)
    return b.groupBy("group_index").agg(F.sum((F.col("keep") & F.col("correct")).cast("long")).alias("kept_correct"), F.sum((F.col("keep") & ~F.col("correct")).cast("long")).alias("kept_incorrect"))


@query("SELECT k, round(avg(CASE WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - list_product(list_transform(range(n-c+1, n+1), lambda i: 1 - k/i)) END), 6) pass_rate, count(*) groups FROM (SELECT n, c, unnest(list_transform(range(0, floor(log2(n))::BIGINT + 1), lambda i: (2**i)::BIGINT)) k FROM (SELECT count(*) n, count(*) FILTER (correct) c FROM grp GROUP BY group_index HAVING count(*) > 1)) GROUP BY k")
def pass_at_k(spark, d):
    rows = groups(spark, d).withColumn("reward", F.col("correct").cast("double"))
    return gr.pass_rates(rows).select("k", r6("pass_rate"), "groups")


QUANT = ", ".join(f"round(quantile_cont(length, {p / 100}), 6) p{p}" for p in (25, 75, 90, 95, 99))


@query(f"SELECT status, round(avg(length), 6) mean, round(median(length), 6) median, max(length) max, min(length) min, {QUANT} FROM grp GROUP BY status")
def length_percentiles(spark, d):
    f = ev.distribution(groups(spark, d), "length", ["status"])
    return f.select("status", *[r6(c) for c in ("mean", "median", "max", "min", "p25", "p75", "p90", "p95", "p99")])


@query("SELECT teacher, (list_sort(list(length)))[floor(count(*)*0.9)::BIGINT + 1] rank_value FROM grp GROUP BY teacher")
def nearest_rank_block(spark, d):
    return ev.nearest_rank(groups(spark, d), "length", ["teacher"], 0.9)


@query("SELECT greatest(1, ceil(length*10/(SELECT max(length) FROM grp)))::BIGINT bucket, round(count(*)/((SELECT count(*) FROM grp)+1e-9), 6) AS \"share\" FROM grp GROUP BY 1")
def length_histogram(spark, d):
    return ev.bucket_shares(groups(spark, d), "length", 10).select("bucket", r6("share"))


@query("SELECT round(avg(reward), 6) mean, round(stddev_pop(reward), 6) std, round(avg(CASE WHEN reward >= 0.1 THEN 1::DOUBLE ELSE 0 END), 6) at_least FROM grp")
def reward_summary(spark, d):
    return groups(spark, d).agg(F.round(F.avg("reward"), 6).alias("mean"), F.round(F.stddev_pop("reward"), 6).alias("std"), F.round(F.avg((F.col("reward") >= 0.1).cast("double")), 6).alias("at_least"))


@query("SELECT status, round(count(*)/sum(count(*)) OVER (), 6) AS \"share\" FROM grp GROUP BY status")
def category_share(spark, d):
    g = groups(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return g.select("status", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT teacher, round(avg(CASE WHEN status = 'aborted' THEN NULL WHEN correct THEN 1::DOUBLE ELSE 0 END), 6) rate FROM grp GROUP BY teacher")
def correct_rate_nullable(spark, d):
    v = F.when(F.col("status") != "aborted", F.col("correct").cast("double"))
    return groups(spark, d).groupBy("teacher").agg(F.round(F.avg(v), 6).alias("rate"))


@query("SELECT round(sum(reward*length)/sum(length), 6) ratio_of_sums, round(avg(reward*length/length), 6) mean_of_ratios FROM grp")
def ratio_vs_mean_ratio(spark, d):
    return groups(spark, d).agg(F.round(F.try_divide(F.sum(F.col("reward") * F.col("length")), F.sum("length")), 6).alias("ratio_of_sums"), F.round(F.avg(F.try_divide(F.col("reward") * F.col("length"), F.col("length"))), 6).alias("mean_of_ratios"))


@query("SELECT teacher, status, count(*) n, round(avg(length), 6) mean_length, round(sum(round(reward*100)::BIGINT)/(100*count(*)), 6) mean_reward, round(count(*) FILTER (correct)/count(*), 6) correct_rate, round(count(*) FILTER (status = 'truncated')/count(*), 6) truncated_rate, max(length) longest FROM grp GROUP BY ROLLUP (teacher, status)")
def panel_rollup(spark, d):
    # Rewards are hundredths: as whole numbers their sum does not depend on its order.
    n, share = F.count(F.lit(1)), lambda c, name: F.round(F.count_if(c) / F.count(F.lit(1)), 6).alias(name)
    hundredths = F.round(F.sum(F.round(F.col("reward") * 100).cast("long")) / (100 * n), 6)
    return groups(spark, d).rollup("teacher", "status").agg(n.alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), hundredths.alias("mean_reward"), share(F.col("correct"), "correct_rate"), share(F.col("status") == "truncated", "truncated_rate"), F.max("length").alias("longest"))


@query("SELECT teacher, round(avg(reward) FILTER (correct), 6) correct, round(avg(reward) FILTER (NOT correct), 6) incorrect, round(avg(reward) FILTER (correct) - avg(reward) FILTER (NOT correct), 6) difference FROM grp GROUP BY teacher")
def advantage_by_correctness(spark, d):
    ok, no = F.avg(F.when(F.col("correct"), F.col("reward"))), F.avg(F.when(~F.col("correct"), F.col("reward")))
    return groups(spark, d).groupBy("teacher").agg(F.round(ok, 6).alias("correct"), F.round(no, 6).alias("incorrect"), F.round(ok - no, 6).alias("difference"))


@query("SELECT group_index, round(c - i, 6) gap, round(CASE WHEN c - i < 0.05 THEN i - c + 0.05 ELSE 0 END, 6) shift FROM (SELECT group_index, avg(reward) FILTER (correct) c, avg(reward) FILTER (NOT correct) i FROM grp GROUP BY 1) WHERE c IS NOT NULL AND i IS NOT NULL")
def margin_shift_group(spark, d):
    # A gap of just delta may round either way in floating point; the shift is then 0 to six places in both.
    return gr.margin_shift(groups(spark, d), 0.05, by_group=True).select("group_index", r6("gap"), r6("shift"))


@query("SELECT round(c - i, 6) gap, round(CASE WHEN c - i < 0.5 THEN i - c + 0.5 ELSE 0 END, 6) shift FROM (SELECT min(reward) FILTER (correct) c, max(reward) FILTER (NOT correct) i FROM grp)")
def margin_shift_global(spark, d):
    return gr.margin_shift(groups(spark, d), 0.5, kind="minmax").select(r6("gap"), r6("shift"))


SIDES = "SELECT group_index, slot, (NOT coalesce(correct, false))::INT side, CASE WHEN coalesce(correct, false) THEN reward ELSE -reward END v FROM grp"
GAINS = "SELECT *, CASE WHEN i < n - greatest(1, floor(n * 0.5)) THEN (s - v)/(n - i - 1) - s/(n - i) END gain FROM (SELECT *, count(*) OVER (PARTITION BY {g} side) n, row_number() OVER o - 1 i, sum(v) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) s FROM s WINDOW o AS (PARTITION BY {g} side ORDER BY v, {t}))"
MASK = """, s AS ({sides}), a AS ({gains}), k AS (SELECT *, min(round(gain, 12)) OVER (PARTITION BY {g} side ORDER BY i) m, sum(CASE WHEN i = 0 THEN s/n END) OVER w gap, count(*) FILTER (i = 0) OVER w sides FROM a WINDOW w AS ({p})),
 b AS (SELECT *, coalesce(sum(gain) OVER ({p} ORDER BY m DESC NULLS LAST, side, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) earlier FROM k)
 SELECT group_index, slot, coalesce(sides = 2 AND gain IS NOT NULL AND m > 0 AND round(gap + earlier, 9) < 0.05, false) masked FROM b"""


def _mask_sql(scope: str) -> str:
    """The whole greedy rule as windows, over groups or over all rows."""
    g = "group_index," if scope == "group" else ""
    return MASK.format(sides=SIDES, gains=GAINS.format(g=g, t="slot" if g else "group_index, slot"), g=g, p="PARTITION BY group_index" if g else "")


@query(_mask_sql("group"))
def greedy_margin_mask(spark, d):
    return gr.greedy_margin_mask(groups(spark, d), 0.05)


@query(_mask_sql("all"))
def global_margin_mask(spark, d):
    return gr.global_margin_mask(groups(spark, d), 0.05)


@query("SELECT teacher, count(*) FILTER (previous IS NOT NULL) repeats, count(*) FILTER (previous <> teacher) switched FROM (SELECT teacher, lag(teacher) OVER (PARTITION BY l_partkey ORDER BY group_index, slot) previous FROM grp) GROUP BY teacher")
def switch_rate(spark, d):
    s = gr.switches(groups(spark, d), ["l_partkey"], ["group_index", "slot"], "teacher")
    return s.groupBy("teacher").agg(F.sum(F.col("is_repeat").cast("long")).alias("repeats"), F.sum(F.col("switched").cast("long")).alias("switched"))


@query("SELECT group_index, slot, correct FROM grp QUALIFY row_number() OVER (PARTITION BY group_index ORDER BY correct, slot) = 1")
def injection_pick(spark, d):
    return gr.injection_pick(groups(spark, d))


@query("SELECT DISTINCT step, round(0.5*greatest(0, 1 - step/20), 6) c FROM tokens")
def anneal_schedule(spark, d):
    return tokens(spark, d).select("step").distinct().select("step", F.round(gr.annealed(0.5, 20.0, F.col("step")), 6).alias("c"))


@query("SELECT group_index, arg_min(teacher, (m, teacher)) teacher, round(min(m), 6) mean FROM (SELECT group_index, teacher, avg(length) m FROM grp GROUP BY 1, 2) GROUP BY 1")
def teacher_argmin(spark, d):
    scores = groups(spark, d).withColumn("score", F.col("length"))
    return gr.argmin_teacher(scores, ["group_index"]).select("group_index", "teacher", r6("mean"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'base' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'fr' ELSE 'base' END teacher FROM documents", views=False)
def label_routing_default(spark, d):
    alias = F.when(F.col("lang") == "es", "default").otherwise(F.col("lang"))
    return gr.routed(table(spark, d, "documents"), alias, {"en": "base", "de": "german"}, "base", {"base", "german", "fr"}).select("doc_id", "teacher")


SCORES = "SELECT suite, model, id, (length(correct) - length(replace(correct, '1', '')))/length(correct) score FROM records"


def _scores(spark, d):
    return ev.question_scores(records(spark, d), ["suite", "model"])


@query(f"SELECT suite, model, id, round(score, 6) score FROM ({SCORES})")
def question_scores(spark, d):
    return _scores(spark, d).select("suite", "model", "id", r6("score"))


@query(f"SELECT model, round(en, 6) en, round(de, 6) de, round(fr, 6) fr, round(es, 6) es, round((en+de)/2, 6) one, round((fr+es)/2, 6) two, round((en+de+fr+es)/4, 6) total FROM (SELECT model, {', '.join(f'100*avg(score) FILTER (suite = {chr(39)}{s}{chr(39)}) {s}' for s in ('en', 'de', 'fr', 'es'))} FROM ({SCORES}) GROUP BY model)")
def suite_levels_macro(spark, d):
    f = ev.levels(_scores(spark, d), {"one": ["en", "de"], "two": ["fr", "es"]}, ["model"])
    return f.select("model", *[r6(c) for c in ("en", "de", "fr", "es", "one", "two", "total")])


def _pairs(spark, d):
    # Two sets of verdicts of the same questions.
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return s.select(F.lit("q-t").alias("contrast"), F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("sa"), F.col("toxic").cast("double").alias("sb"))


@query("SELECT 'q-t' contrast, round(avg(x), 6) delta, count(*) suites FROM (SELECT 100*(avg(quality) - avg(toxic)) x FROM labels JOIN documents USING (doc_id) GROUP BY lang)", views=False)
def paired_contrast_point(spark, d):
    return ev.contrast_points(_pairs(spark, d), ["contrast"]).select("contrast", r6("delta"), "suites")


@query()
def paired_bootstrap_exact(spark, d):
    return iv.bootstrap(_pairs(spark, d), ["contrast"], ["de", "en", "es", "fr"])


@query()
def seed_read(spark, d):
    # Three seeds of a method: all questions' last two, first and third samples of four.
    r = records(spark, d).select("suite", "id", F.split("correct", "").alias("c"), F.explode(F.array(*[F.lit(x) for x in (42, 43, 44)])).alias("seed"))
    at = lambda k: F.element_at("c", k).cast("double")
    sa = F.when(F.col("seed") == 42, at(F.lit(1))).when(F.col("seed") == 43, at(F.lit(2))).otherwise(at(F.lit(3)))
    pairs = r.groupBy("seed", "suite", "id").agg(F.avg(sa).alias("sa"), F.avg(at(F.lit(4))).alias("sb"))
    return iv.seed_read(pairs, "seed", [42, 43, 44], ["de", "en", "es", "fr"])


@query("SELECT suite, id, a.correct <> b.correct AS differs FROM records a JOIN (SELECT suite, id, reverse(correct) correct FROM records) b USING (suite, id)")
def paired_join_check(spark, d):
    # The second model's answers are the first one's from the end.
    r = records(spark, d).groupBy("suite", "id").agg(F.first("correct").alias("correct"))
    both = r.select("suite", "id", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("correct").alias("score")), F.struct(F.lit("b").alias("model"), F.reverse("correct").alias("score")))).alias("x")).select("suite", "id", "x.*")
    return ev.paired(both, "a", "b").select("suite", "id", (F.col("sa") != F.col("sb")).alias("differs"))


@query("SELECT doc_id FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 5 = 0)", views=False)
def seen_antijoin(spark, d):
    docs = table(spark, d, "documents").withColumn("key", text.canonical_key(F.col("text")))
    return docs.join(docs.where("doc_id % 5 = 0").select("key").distinct(), "key", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", views=False)
def source_semijoin(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT coalesce(a.doc_id, b.doc_id) doc_id, CASE WHEN a.doc_id IS NULL THEN 'only right' WHEN b.doc_id IS NULL THEN 'only left' ELSE 'differs' END difference FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END lang FROM documents WHERE doc_id % 10 <> 2) b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang", views=False)
def catalog_diff(spark, d):
    docs = table(spark, d, "documents")
    b = docs.where("doc_id % 10 <> 2").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    return pr.catalogue_diff(docs.where("doc_id % 10 <> 1"), b, "doc_id", ["lang"])


@query("SELECT p.sample_id, p.pos, (SELECT arg_max(e.domain, e.pos) FROM tokens e WHERE e.mask AND e.sample_id = p.sample_id AND e.pos < p.pos) AS domain FROM tokens p WHERE NOT p.mask")
def asof_last_applied(spark, d):
    t = tokens(spark, d)
    return pr.last_before(t.where("mask"), t.where("not mask"), ["sample_id"], "pos", "domain").select("sample_id", "pos", "domain")


@query("SELECT d.doc_id id, max_by(p.prefix, length(p.prefix)) prefix FROM documents d JOIN (SELECT DISTINCT left(text, (5 + doc_id % 3 * 10)::BIGINT) prefix FROM documents WHERE doc_id % 4 = 0) p ON starts_with(d.text, p.prefix) GROUP BY d.doc_id", views=False)
def prefix_match(spark, d):
    docs = table(spark, d, "documents")
    cached = docs.where("doc_id % 4 = 0").select(F.expr("left(text, 5 + doc_id % 3 * 10)").alias("prefix"))
    return pr.longest_prefix(docs.select(F.col("doc_id").alias("id"), "text"), cached)


@query("SELECT sha256(text) AS \"key\", min(doc_id) doc_id, arg_min(lang, doc_id) lang, max(n_chars) n_chars FROM documents GROUP BY text", views=False)
def first_occurrence_dedup(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.sha2("text", 256))
    return pr.first_occurrences(docs, "key", "doc_id", ["lang"], ["n_chars"])


FILL = "WITH s AS (SELECT doc_id, sha1(text) k, nullif(lang, 'es') label FROM documents WHERE doc_id % 10 = 0), p AS (SELECT doc_id, sha1(text) k, nullif(lang, 'es') label FROM documents WHERE doc_id % 10 <> 0)"


@query(f"{FILL}, f AS (SELECT * FROM p WHERE label IS NOT NULL AND k NOT IN (SELECT k FROM s WHERE label IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1 ORDER BY doc_id LIMIT greatest(0, 150 - (SELECT count(*) FROM s))) SELECT doc_id, 0 src FROM s UNION ALL SELECT doc_id, 1 FROM f", views=False)
def seeded_fill_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("k"), F.expr("nullif(lang, 'es')").alias("label"))
    return pr.seeded_fill(docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 <> 0"), "k", "doc_id", "label", 150).select("doc_id", "src")


@query("SELECT o_orderkey, (p % 8)::INT AS shard, floor(p / ceil((SELECT count(*) FROM orders)/4))::INT AS block FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 p FROM orders)", views=False)
def shard_round_robin(spark, d):
    o = table(spark, d, "orders")
    placed, n = pr.places(o, ["o_orderdate", "o_orderkey"])
    both = pr.round_robin(placed, F.col("place"), 8)
    return pr.contiguous(both.withColumnRenamed("shard", "rr"), F.col("place"), n, 4).select("o_orderkey", F.col("rr").alias("shard"), F.col("shard").alias("block"))


@query()
def karmarkar_karp(spark, d):
    # A rollout's batch: a teacher's samples of 500 consecutive group indices.
    batches = groups(spark, d).withColumn("batch", F.expr("group_index div 500"))
    return pt.assign(batches, ["teacher", "batch"], ["group_index", "slot"], "length", lambda c: pt.differencing(c, 8))


@query()
def equal_parts(spark, d):
    # As many samples for each of eight workers; a batch short of a multiple is filled up with empty ones.
    def even(costs: list[int]) -> list[list[int]]:
        filled = costs + [0] * (-len(costs) % 8)
        return [[i for i in part if i < len(costs)] for part in pt.differencing(filled, 8, equal=True)]

    batches = groups(spark, d).withColumn("batch", F.expr("group_index div 500"))
    return pt.assign(batches, ["teacher", "batch"], ["group_index", "slot"], "length", even)


# Item by item: the first bin of a group's loads with room, or a new one.
FIRST_FIT = "WITH RECURSIVE" + WITH.removeprefix("WITH") + """, g AS (SELECT group_index, slot, length, length::BIGINT c, row_number() OVER (PARTITION BY group_index ORDER BY slot) n FROM grp),
 r AS (SELECT group_index, slot, length, n, [c] loads, 1::BIGINT k FROM g WHERE n = 1 UNION ALL
 SELECT group_index, slot, length, n, CASE WHEN k <= len(loads) THEN list_transform(loads, lambda v, i: CASE WHEN i = k THEN v + c ELSE v END) ELSE list_append(loads, c) END, k
 FROM (SELECT g.*, r.loads, coalesce(list_min(list_filter(range(1, len(r.loads) + 1), lambda x: r.loads[x] + g.c <= 60)), len(r.loads) + 1) k FROM r JOIN g ON g.group_index = r.group_index AND g.n = r.n + 1))
 SELECT group_index, slot, length, (k - 1)::INT part FROM r"""


@query(FIRST_FIT, views=False)
def first_fit_bins(spark, d):
    return pt.assign(groups(spark, d), ["group_index"], ["slot"], "length", lambda c: pt.first_fit(c, 60))


CHECKS = '[{"type":"word_count_min","n":5},{"type":"no_commas"},{"type":"paragraph_count","n":1},{"type":"must_include","values":["The","a"]}]'


@query(r"SELECT conv_id, turn, wc >= 5 AND NOT contains(text, ',') AND p = 1 AND inc satisfied, (wc >= 5)::INT + (NOT contains(text, ','))::INT + (p = 1)::INT + inc::INT n_satisfied FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) wc, len(list_filter(regexp_split_to_array(trim(text), '\n\s*\n'), lambda x: trim(x) <> '')) p, contains(lower(text), 'the') AND contains(lower(text), 'a') inc FROM responses)")
def if_checks(spark, d):
    specs = F.from_json(F.lit(CHECKS), text.SPEC, {"mode": "FAILFAST"})
    return responses(spark, d).select("conv_id", "turn", text.score(F.col("text"), specs).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT item_id, round(CASE WHEN s = 0 THEN 0 ELSE 2*(s/p)*(s/t)/(s/p+s/t) END, 6) f1 FROM (SELECT item_id, list_sum(list_transform(list_intersect(p, t), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))) s0, coalesce(s0, 0) s, len(p) p, len(t) t FROM (SELECT a.item_id, list_filter(regexp_split_to_array(regexp_replace(lower(translate(a.text, '.,', '')), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda x: x <> '') p, list_filter(regexp_split_to_array(regexp_replace(lower(translate(b.text, '.,', '')), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda x: x <> '') t FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1))", views=False)
def token_f1(spark, d):
    b = table(spark, d, "benchmark")
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return both.select("item_id", F.round(text.token_f1(F.col("text"), F.col("other"))["f1"], 6).alias("f1"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END box FROM documents", views=False)
def boxed_extract(spark, d):
    docs = table(spark, d, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\\boxed{unclosed"))).otherwise(F.concat(F.lit("\\boxed{1} "), "text", F.lit("\\boxed{"), F.col("doc_id").cast("string"), F.lit("}")))
    return docs.select("doc_id", answers.boxed_column(said).alias("box"))


@query()
def repetition_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.repetitive_column(F.col("text")).alias("repetitive"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) valid FROM events", views=False)
def json_valid(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return e.select("event_id", text.json_valid(said).alias("valid"))


@query("SELECT doc_id, sha1(text) sha1, sha256(text) sha256 FROM documents", views=False)
def prompt_key_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("SELECT conv_id, sum(n)::INT words, coalesce(sum(n) FILTER (role = 'assistant'), 0)::INT masked_in FROM (SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) n FROM conversations) GROUP BY conv_id", views=False)
def loss_mask_by_role(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    mask = pr.role_mask(F.col("turns"))
    return turns.select("conv_id", F.size(mask).alias("words"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("masked_in"))


@query("SELECT doc_id id, text, NULL::VARCHAR teacher, 0 file_ord FROM documents UNION ALL SELECT item_id, text, 'code', 1 FROM benchmark", views=False)
def mixture_union(spark, d):
    docs, bench = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return mixture([Part(docs, {"doc_id": "id"}), Part(bench, {"item_id": "id", "text": "text"}, "code")]).select("id", "text", "teacher", "file_ord")


@query("SELECT doc_id::VARCHAR path, CASE WHEN doc_id % 5 = 0 THEN 'NO MANIFEST ENTRY' WHEN doc_id % 7 = 0 THEN 'MISMATCH' ELSE 'MATCH' END verdict FROM documents", views=False)
def manifest_verdict(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    known = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return pr.manifest_verdicts(files, known)


@query("SELECT reason, count(*) n FROM (SELECT CASE WHEN status = 'truncated' THEN 'truncated' WHEN l_suppkey % 11 = 0 THEN 'prompt_ids_mismatch' WHEN status = 'aborted' THEN 'verifier_none' WHEN NOT correct THEN 'wrong' END reason FROM grp) GROUP BY reason")
def keep_cascade(spark, d):
    g = groups(spark, d).withColumns({"finish_reason": F.when(F.col("status") == "truncated", "length").otherwise("stop"), "prompt_ids_match": F.col("l_suppkey") % 11 != 0, "correct": F.when(F.col("status") != "aborted", F.col("correct"))})
    return gr.keep_cascade(g).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) // 128 * 128 FROM orders)", views=False)
def trim_to_batch(spark, d):
    return gr.trimmed(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 128)


@query("SELECT group_index, slot, greatest(least(30, 60 - length), 0)::DOUBLE budget, CASE WHEN least(30, 60 - length) <= 0 THEN 'truncated' ELSE 'pending' END status FROM (SELECT *, length * 1.5 AS length2 FROM grp)")
def token_budget(spark, d):
    budget, status = ro.token_budget(30, 60, F.col("length"))
    return groups(spark, d).select("group_index", "slot", budget.cast("double").alias("budget"), status.alias("status"))


@query("SELECT group_index, slot, CASE WHEN status <> 'aborted' THEN correct ELSE reward >= 1.0 END verdict FROM grp")
def strict_verdicts(spark, d):
    flag = F.when(F.col("status") != "aborted", F.col("correct"))
    return groups(spark, d).select("group_index", "slot", ro.strict_verdict(flag, F.col("reward")).alias("verdict"))


@query("SELECT group_index, slot, t AS teacher, CASE WHEN t = g.teacher THEN reward END score FROM grp g, (VALUES ('t0'), ('t1'), ('t2')) v(t)")
def teacher_fanout(spark, d):
    g = groups(spark, d)
    scores = g.select("group_index", "slot", "teacher", F.col("reward").alias("score"))
    return ro.fan_out(g.select("group_index", "slot"), ["t0", "t1", "t2"], scores, ["group_index", "slot"])


@query("SELECT status, count(*) n, round(sum(length)/sum(l_partkey % 10 + 1), 6) tokens_per_second, max(length) longest, round(avg(length/(l_partkey % 10 + 1)) FILTER (length = m), 6) longest_rate FROM (SELECT *, max(length) OVER (PARTITION BY status) m FROM grp) GROUP BY status")
def throughput(spark, d):
    rows = groups(spark, d).withColumn("seconds", F.col("l_partkey") % 10 + 1)
    f = ro.throughput(rows, ["status"], "length", "seconds")
    return f.select("status", "n", r6("tokens_per_second"), "longest", r6("longest_rate"))


@query("SELECT count(*) n, count(DISTINCT doc_id) = count(*) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 contiguous FROM documents", views=False)
def contiguity_check(spark, d):
    return ro.contiguity(table(spark, d, "documents"), "doc_id")


@query("SELECT teacher, max(length) >= 50 passed FROM grp GROUP BY teacher")
def metric_gate(spark, d):
    return ro.gate(groups(spark, d), ["teacher"], "length", 50.0)


@query("SELECT sample_id, min(pos) AS first, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, adv < 0 ORDER BY pos) island FROM tokens) WHERE adv < 0 GROUP BY sample_id, island HAVING count(*) >= 3")
def failure_streaks(spark, d):
    return ro.streaks(tokens(spark, d), ["sample_id"], ["pos"], F.col("adv") < 0, 3)


@query("SELECT group_index, slot, coalesce(sum(length) OVER (PARTITION BY group_index ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM grp")
def packed_offsets(spark, d):
    return ro.offsets(groups(spark, d), ["group_index"], ["slot"], "length").select("group_index", "slot", "start")


PARAMS = "SELECT label model, i idx, avg(embedding[i]::DOUBLE) v FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) i FROM embeddings) GROUP BY label, i"


def _parameters(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("idx", "v"))
    return e.groupBy(F.col("label").alias("model"), (F.col("idx") + 1).cast("long").alias("idx")).agg(F.avg(F.col("v").cast("double")).alias("value")).withColumn("name", F.lit("w"))


@query(f"SELECT 'w' AS name, idx, round(avg(v), 5) AS value FROM ({PARAMS}) GROUP BY idx", views=False)
def parameter_average(spark, d):
    return ro.averaged(_parameters(spark, d)).select("name", "idx", F.round("value", 5).alias("value"))


@query(f"WITH p AS ({PARAMS}) SELECT 'w' AS name, b.idx, round(b.v + 0.3::DOUBLE * (sum(t.v) - count(*) * b.v), 5) AS value FROM p b JOIN p t ON b.idx = t.idx AND b.model = 0 AND t.model > 0 GROUP BY b.idx, b.v", views=False)
def task_arithmetic(spark, d):
    p = _parameters(spark, d)
    return ro.task_arithmetic(p.where("model = 0"), p.where("model > 0"), 0.3).select("name", "idx", F.round("value", 5).alias("value"))


@query(f"SELECT a.model, a.suite, round(a.s - b.s, 6) difference FROM (SELECT model, suite, avg(score) s FROM ({SCORES}) GROUP BY 1, 2) a JOIN (SELECT suite, avg(score) s FROM ({SCORES}) WHERE model = 'src0' GROUP BY 1) b USING (suite) WHERE a.model <> 'src0' AND a.s < b.s")
def specialist_drops(spark, d):
    means = _scores(spark, d).groupBy("model", "suite").agg(F.avg("score").alias("score"))
    return ro.drops(means, "src0").select("model", "suite", r6("difference"))


@query("SELECT conv_id session_id, sum(n)::INT tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::INT trained FROM (SELECT conv_id, role, length(text) n FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')) GROUP BY conv_id", views=False)
def session_samples(spark, d):
    # Each assistant turn is a record whose prompt is all text before it, as code points.
    codes = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", codes(F.col("text")).alias("ids"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = turns.withColumn("prompt_ids", F.flatten(F.collect_list("ids").over(before)))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    seen = seen.withColumn("_last", last).where(F.col("_last").isNotNull())
    log = seen.where("role = 'assistant' or turn > _last").select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "assistant", F.col("prompt_ids")).otherwise(F.concat("prompt_ids", "ids")).alias("prompt_ids"), F.when(F.col("role") == "assistant", F.col("ids")).otherwise(F.array().cast("array<int>")).alias("output_ids"))
    log = log.withColumn("logprobs", F.transform("output_ids", lambda x: F.lit(-1.0)))
    s = ro.session_samples(log)
    return s.select("session_id", F.size("tokens").alias("tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("trained"))
