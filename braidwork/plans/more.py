"""Registered queries of the operators around the batch: catalogues, cells, prompt sets, logs, losses, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import answers, text, values
from braidwork.operators import constraints
from braidwork.operators import evaluation as ev
from braidwork.operators import groups as gr
from braidwork.operators import hook
from braidwork.operators import normalizer as nz
from braidwork.operators import prompts as pr
from braidwork.operators import ranges
from braidwork.operators import rollouts as ro
from braidwork.operators import tokens as tk
from braidwork.plans.queries import CLIP, MULT, STD, query, r6
from braidwork.plans.views import groups, table, tokens

DOMAINS = {"one": ["en", "de"], "two": ["fr", "es"]}
# Question records: a model for each source, a suite for each language.
CELLS = """SELECT source model, lang suite, doc_id::VARCHAR id, concat((doc_id % 2)::VARCHAR, (doc_id % 3 % 2)::VARCHAR, (n_chars % 2)::VARCHAR, '1') correct, 4 n, (n_chars % 1000)::DOUBLE mean_tokens, (doc_id % 3)::INT cap_hits FROM documents"""
SHARE = "(length(correct) - length(replace(correct, '1', '')))/length(correct)"
SUMMARY = f"SELECT model, suite, count(*) problems, sum(n)::BIGINT samples, avg({SHARE}) mean_pass1, sum(mean_tokens*n)/sum(n) mean_output_tokens, sum(cap_hits)/sum(n) cap_hit_rate FROM ({CELLS}) GROUP BY model, suite"


def _records(spark, d):
    correct = F.concat(F.col("doc_id") % 2, F.col("doc_id") % 3 % 2, F.col("n_chars") % 2, F.lit("1"))
    return table(spark, d, "documents").select(F.col("source").alias("model"), F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("id"), correct.alias("correct"), F.lit(4).alias("n"), (F.col("n_chars") % 1000).cast("double").alias("mean_tokens"), (F.col("doc_id") % 3).cast("int").alias("cap_hits"))


@query(f"SELECT model, suite, problems, samples, round(mean_pass1, 6) mean_pass1, round(mean_output_tokens, 6) mean_output_tokens, round(cap_hit_rate, 6) cap_hit_rate FROM ({SUMMARY})", views=False)
def cell_summary(spark, d):
    return ev.cell_summary(_records(spark, d), ["model", "suite"]).select("model", "suite", "problems", "samples", r6("mean_pass1"), r6("mean_output_tokens"), r6("cap_hit_rate"))


@query(f"SELECT model, suite, CASE suite WHEN 'es' THEN 'not recorded' WHEN 'fr' THEN 'differs' ELSE 'agrees' END state FROM ({SUMMARY})", views=False)
def cells_against_recorded(spark, d):
    cells = ev.cell_summary(_records(spark, d), ["model", "suite"])
    recorded = cells.where("suite <> 'es'").withColumn("mean_pass1", F.col("mean_pass1") + F.when(F.col("suite") == "fr", 1e-6).otherwise(0.0))
    found = ev.checked_cells(cells, recorded, ["model", "suite"])
    return found.select("model", "suite", F.when(F.col("agrees"), "agrees").when(~F.col("agrees"), "differs").otherwise("not recorded").alias("state"))


@query(f"SELECT model, round(CASE WHEN a = 2 THEN x END, 6) one_tokens, round(CASE WHEN b = 2 THEN y END, 6) two_tokens, round(CASE WHEN a + b = 4 THEN z END, 6) cap_hit_rate FROM (SELECT model, count(*) FILTER (suite IN ('en', 'de')) a, count(*) FILTER (suite IN ('fr', 'es')) b, avg(mean_output_tokens) FILTER (suite IN ('en', 'de')) x, avg(mean_output_tokens) FILTER (suite IN ('fr', 'es')) y, avg(cap_hit_rate) z FROM ({SUMMARY}) WHERE NOT (model = 'src1' AND suite = 'es') GROUP BY model)", views=False)
def level_tokens(spark, d):
    cells = ev.cell_summary(_records(spark, d), ["model", "suite"]).where("not (model = 'src1' and suite = 'es')")
    return ev.level_tokens(cells, DOMAINS, ["model"]).select("model", r6("one_tokens"), r6("two_tokens"), r6("cap_hit_rate"))


@query(f"SELECT model, suite, field, ok FROM (SELECT model, suite, unnest(['mean_pass1', 'cap_hit_rate']) field, unnest([suite <> 'fr', true]) ok FROM ({SUMMARY}))", views=False)
def published_cells(spark, d):
    cells = ev.cell_summary(_records(spark, d), ["model", "suite"])
    published = cells.withColumn("mean_pass1", F.col("mean_pass1") + F.when(F.col("suite") == "fr", 2e-6).otherwise(5e-7))
    return ev.published_check(cells, published, ["model", "suite"], ["mean_pass1", "cap_hit_rate"]).select("model", "suite", "field", "ok")


@query(f"SELECT model, round(avg({SHARE}), 6) score, round(avg({SHARE}) FILTER (id::BIGINT % 5 <> 0), 6) score_without, count(*) FILTER (id::BIGINT % 5 = 0) left_out FROM ({CELLS}) GROUP BY model", views=False)
def score_without_listed(spark, d):
    scores = ev.question_scores(_records(spark, d), ["model"])
    listed = scores.where(F.col("id").cast("long") % 5 == 0)
    return ev.score_without(scores, listed, ["model"]).select("model", r6("score"), r6("score_without"), "left_out")


@query("SELECT lang suite, count(*) problems, 2 * count(*) samples, round(avg(CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0 END), 6) mean_pass1, round(avg(n_chars / 2), 6) mean_output_tokens, round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0 END), 6) cap_hit_rate FROM documents GROUP BY lang", views=False)
def graded_summary(spark, d):
    docs = table(spark, d, "documents")
    known = pr.catalogue(docs.withColumnRenamed("doc_id", "id"), F.coalesce("text", F.lit("")), F.concat(F.lit("a"), F.col("id")))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("it is a"), F.col("doc_id"))).otherwise(F.lit("none"))
    reasons = F.array(F.when(F.col("doc_id") % 4 == 0, "length").otherwise("stop"), F.lit("stop"))
    rows = docs.select(F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_sha256"), F.array(said, F.lit("a")).alias("responses"), F.array(F.col("n_chars").cast("double"), F.lit(0.0)).alias("token_counts"), reasons.alias("finish_reasons"))
    _, cells = ev.graded(rows, known, ["suite"])
    return cells.select("suite", "problems", F.col("samples").cast("long").alias("samples"), r6("mean_pass1"), r6("mean_output_tokens"), r6("cap_hit_rate"))


@query("SELECT domain, count(*) FILTER (NOT c) not_covered FROM (SELECT lang domain, coalesce(l.doc_id IS NOT NULL, false) c FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY domain", views=False)
def bank_coverage(spark, d):
    found = pr.covered(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return found.groupBy(F.col("lang").alias("domain")).agg(F.count_if(~F.col("covered")).alias("not_covered"))


@query("SELECT l.doc_id, lang, quality, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id", views=False)
def verified_chain(spark, d):
    docs = table(spark, d, "documents")
    return pr.chained(table(spark, d, "labels"), [docs.select("doc_id", "lang"), docs.select("doc_id", "n_chars")], ["doc_id"]).select("doc_id", "lang", "quality", "n_chars")


@query("SELECT place, item_id, text FROM benchmark JOIN (SELECT unnest([0, 1, 2, 3]) place, unnest([3, 0, 5, 3]) item_id) USING (item_id)", views=False)
def pool_by_place(spark, d):
    return pr.positional(table(spark, d, "benchmark"), "item_id", [3, 0, 5, 3]).select("place", "item_id", "text")


@query("SELECT sha1(text) \"key\", count(*) n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2", views=False)
def repeated_keys(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("key", F.sha1("text"))
    return pr.frequent(docs, "key", 2)


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) <= 60", views=False)
def short_prompts(spark, d):
    return pr.short_prompts(table(spark, d, "documents"), "text", 60).select("doc_id")


@query("SELECT doc_id, doc_id src_index FROM documents WHERE coalesce(nullif(lang, 'es'), source) = 'de'", views=False)
def rows_of_domain(spark, d):
    domain = F.coalesce(F.nullif("lang", F.lit("es")), "source")
    return pr.of_domain(table(spark, d, "documents"), domain, "de", "doc_id").select("doc_id", "src_index")


@query("SELECT group_index FROM grp GROUP BY group_index HAVING avg(correct::INT) BETWEEN 0.125 AND 0.875")
def pass_rate_band(spark, d):
    rates = groups(spark, d).groupBy("group_index").agg(F.avg(F.col("correct").cast("int")).alias("pass_rate"))
    return pr.pass_band(rates).select("group_index")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) r FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5000)) WHERE r = 1 ORDER BY doc_id LIMIT 100", views=False)
def unrepeated_prompts(spark, d):
    return pr.unrepeated(table(spark, d, "documents"), F.col("text"), "doc_id", 100).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE event_type END rm_type, json_extract_string(props, '$.k') k FROM events", views=False)
def metadata_overrides(spark, d):
    given = F.from_json("props", "map<string,string>")
    over = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("rm_type"), F.lit("own"))).otherwise(F.expr("map()").cast("map<string,string>"))
    m = pr.overridden(given, F.col("event_type"), over)
    return table(spark, d, "events").select("event_id", m["rm_type"].alias("rm_type"), m["k"].alias("k"))


@query("SELECT event_id, 3 n, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END filled FROM events", views=False)
def instruction_arguments(spark, d):
    one = F.create_map(F.lit("n"), F.when(F.col("event_id") % 2 == 0, F.lit("4")), F.lit("none"), F.lit(None).cast("string"))
    args = pr.arguments(F.array(one), F.lit(3))
    return table(spark, d, "events").select("event_id", F.size(args).alias("n"), F.size(F.filter(args, lambda m: F.size(m) > 0)).alias("filled"))


@query("SELECT doc_id, text || chr(10) || 'Put the answer in a box.' prompt, nullif(lang, 'es') label FROM documents", views=False)
def suffixed_prompts(spark, d):
    # A struct that is missing as a whole gives null, as does one without the field.
    model = F.when(F.col("lang") != "es", F.struct(F.col("lang").alias("ground_truth"))).alias("reward_model")
    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\nPut the answer in a box.")).alias("prompt"), model)
    return rows.select("doc_id", "prompt", F.col("reward_model.ground_truth").alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'both' WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END side FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0", views=False)
def key_sets(spark, d):
    docs = table(spark, d, "documents")
    return pr.key_sets(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT domain, count(*) n, min(src_index) >= 0 placed FROM (SELECT lang domain, min(doc_id) src_index, row_number() OVER (PARTITION BY lang ORDER BY text) r FROM documents WHERE lang IN ('en', 'de') AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE lang = 'fr' AND text IS NOT NULL) GROUP BY lang, text) WHERE r <= 40 GROUP BY domain", views=False)
def student_prompts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    docs = docs.join(docs.where("lang = 'fr'").select("text").distinct(), "text", "left_anti")
    pool = lambda lang: docs.where(F.col("lang") == lang).select(F.sha1("text").alias("key"), F.col("doc_id").alias("src_index"), F.lit("x").alias("label"))
    found = pr.student_set({"en": pool("en"), "de": pool("de")}, 40, 7)
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), (F.min("src_index") >= 0).alias("placed"))


@query("SELECT teacher, count(*) n, round(count(*) FILTER (status = 'truncated')/count(*), 6) truncated_ratio, round(count(*) FILTER (l_partkey % 9 = 0)/count(*), 6) repetition_frac FROM grp GROUP BY teacher")
def rollout_rates(spark, d):
    f = ro.rates(groups(spark, d), ["teacher"], F.col("status") == "truncated", F.col("l_partkey") % 9 == 0)
    return f.select("teacher", "n", r6("truncated_ratio"), r6("repetition_frac"))


@query("SELECT source, count(*) total, count(*) FILTER (lang = 'en') multimodal, count(*) FILTER (lang IS DISTINCT FROM 'en') text_only, round(100 * count(*) / (SELECT count(*) FROM documents), 6) percentage FROM documents GROUP BY source", views=False)
def source_counters(spark, d):
    f = ro.counters(table(spark, d, "documents"), ["source"], F.col("lang") == "en")
    return f.select("source", "total", "multimodal", "text_only", r6("percentage"))


TURNS = r"SELECT conv_id, count(*) rounds, sum(n)::BIGINT raw, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT own FROM (SELECT conv_id, role, len(regexp_extract_all(text, '\S+')) n FROM conversations) GROUP BY conv_id"


@query(f"SELECT (conv_id % 4)::INT part, round(avg(raw), 6) raw_mean, max(raw)::INT raw_max, min(raw)::INT raw_min, round(avg(own), 6) own_mean, max(own)::INT own_max, min(own)::INT own_min, round(count(*) FILTER (raw >= 200)/count(*), 6) clip_ratio, round(avg(rounds), 6) rounds_mean FROM ({TURNS}) GROUP BY 1", views=False)
def turn_lengths(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    masks = turns.select((F.col("conv_id") % 4).cast("int").alias("part"), pr.role_mask(F.col("turns")).alias("mask"), F.size("turns").alias("rounds"))
    f = ro.turn_lengths(masks, ["part"], "mask", "rounds", 200)
    return f.select("part", *[c if c[4:] in ("max", "min") else r6(c) for c in ("raw_mean", "raw_max", "raw_min", "own_mean", "own_max", "own_min", "clip_ratio", "rounds_mean")])


@query("SELECT o_orderkey, p group_index, slot::INT slot, p * 4 + slot AS \"index\" FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 p FROM orders), range(4) r(slot)", views=False)
def sample_numbers(spark, d):
    placed, _ = pr.places(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return ro.numbered(placed, "place", 4).select("o_orderkey", "group_index", "slot", "index")


@query("SELECT event_type AS \"timer\", sum(event_id % 10)::BIGINT AS \"seconds\", count(*) AS calls FROM events GROUP BY event_type", views=False)
def timer_sums(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("timer"), F.col("user_id").alias("start"), (F.col("user_id") + F.col("event_id") % 10).alias("stop"))
    return ro.elapsed(log)


@query("SELECT lang, count(*) n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id))::INT AS rank FROM documents GROUP BY lang", views=False)
def most_common_values(spark, d):
    return ro.most_common(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 1 END source FROM documents ORDER BY 2, 1 LIMIT 50", views=False)
def buffer_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return ro.buffer_first(docs.where("doc_id % 10 = 3"), docs.where("doc_id % 10 <> 3"), "doc_id", 50)


@query("SELECT r_regionkey::INT AS region, arg_min(n_name, (nl, n_name)) worker, min(nl)::INT AS load FROM (SELECT n_regionkey r_regionkey, n_name, length(n_name) nl FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY 1", views=False)
def least_loaded_worker(spark, d):
    workers = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("worker"), F.length("n_name").alias("load"), (F.col("n_nationkey") % 4 != 0).alias("healthy"))
    return ro.least_loaded_worker(workers, ["region"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) a, row_number() OVER (ORDER BY doc_id DESC) b, floor(count(*) OVER () * 0.1 / 2) h FROM documents) WHERE a <= h OR b <= h", views=False)
def dump_ends(spark, d):
    return ro.ends(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.1)


@query("SELECT step, (step + 1) % 5 = 0 OR (step + 1) % 7 = 0 OR step = 30 due, step * 4 first_step, strftime(make_date(2024, 1, step::INT), '%Y-%m-%d') AS day FROM (SELECT DISTINCT step FROM tokens)")
def periodic_steps(spark, d):
    step = F.col("step")
    day = F.date_format(F.make_date(F.lit(2024), F.lit(1), step.cast("int")), "yyyy-MM-dd")
    return tokens(spark, d).select("step").distinct().select("step", ro.periodic(step, 5, 7, 30).alias("due"), ro.rollout_step(step, 32, 8).cast("long").alias("first_step"), day.alias("day"))


@query("SELECT doc_id, n_chars FROM documents", views=False)
def restored_order(spark, d):
    docs = table(spark, d, "documents")
    sent = docs.select(F.xxhash64("doc_id").alias("at"), "doc_id")
    return ro.restored(sent, docs.select(F.xxhash64("doc_id").alias("at"), "n_chars"), "at", "doc_id")


RUNS = "SELECT source model, CASE WHEN n_chars < 300 THEN 8192 ELSE 16384 END cap, lang suite FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL"


@query(f"SELECT m.model, c.cap, s.suite, count(r.model) n FROM (SELECT DISTINCT model FROM ({RUNS})) m, (SELECT DISTINCT cap FROM ({RUNS})) c, (SELECT DISTINCT suite FROM ({RUNS})) s LEFT JOIN ({RUNS}) r ON r.model = m.model AND r.cap = c.cap AND r.suite = s.suite GROUP BY 1, 2, 3", views=False)
def evaluation_cells(spark, d):
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    return ro.cells(docs.select(F.col("source").alias("model"), F.when(F.col("n_chars") < 300, 8192).otherwise(16384).alias("cap"), F.col("lang").alias("suite")), ["model", "cap", "suite"])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", views=False)
def table_lookup(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return ro.looked_up(table(spark, d, "customer"), nations, ["c_nationkey"], "n_name").select("c_custkey", "n_name")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'kept' ELSE 'left' END state FROM documents", views=False)
def resumed_chunks(spark, d):
    todo = table(spark, d, "documents").select("doc_id", F.lit("v2").alias("revision"))
    cache = todo.where("doc_id % 3 = 0").withColumn("revision", F.when(F.col("doc_id") % 4 == 0, "v1").otherwise("v2"))
    kept, left = ro.resumed(todo, cache.union(cache), "doc_id", ["revision"])
    return kept.select("doc_id", F.lit("kept").alias("state")).union(left.select("doc_id", F.lit("left").alias("state")))


@query("SELECT teacher, round(avg((status = 'completed')::INT), 6) mean_new, count(*) FILTER ((status = 'completed')::INT <> reward) changed FROM grp GROUP BY teacher")
def rescored_dump(spark, d):
    f = ro.rescored(groups(spark, d), (F.col("status") == "completed").cast("double"))
    return f.groupBy("teacher").agg(F.round(F.avg("new_reward"), 6).alias("mean_new"), F.count_if(F.col("difference") != 0).alias("changed"))


@query("SELECT teacher, count(*) problems, sum(n)::BIGINT samples, round(sum(h)/(100*sum(n)), 6) mean_reward, round(sum(t)/sum(n), 6) truncated_ratio, round(sum(b)/(100*count(*)), 6) best_reward FROM (SELECT teacher, group_index, count(*) n, sum(round(reward*100)::BIGINT) h, max(round(reward*100)::BIGINT) b, count(*) FILTER (status = 'truncated') t FROM grp GROUP BY 1, 2) GROUP BY teacher")
def eval_rollout_log(spark, d):
    f = ro.eval_log(groups(spark, d).withColumn("reward", F.round(F.col("reward") * 100)), "teacher", "group_index")
    return f.select("teacher", "problems", "samples", F.round(F.col("mean_reward") / 100, 6).alias("mean_reward"), r6("truncated_ratio"), F.round(F.col("best_reward") / 100, 6).alias("best_reward"))


@query("SELECT domain, round(avg(CASE WHEN sample_id % 4 = 1 THEN 0.25 ELSE adv END), 6) mean FROM tokens GROUP BY domain")
def injected_constants(spark, d):
    constant = F.when(F.col("sample_id") % 4 == 1, 0.25).otherwise(0.0)
    return tokens(spark, d).groupBy("domain").agg(F.round(F.avg(tk.injected(F.col("adv"), constant)), 6).alias("mean"))


@query("SELECT domain, round(avg(CASE WHEN abs(s_lp - t_lp) < 0.5 THEN adv ELSE 0 END), 6) loss, count(*) FILTER (abs(s_lp - t_lp) < 0.5) near FROM tokens GROUP BY domain")
def near_teacher_mask(spark, d):
    near = tk.near_teacher(F.col("s_lp"), F.col("t_lp"), 0.5)
    return tokens(spark, d).groupBy("domain").agg(F.round(F.avg(F.col("adv") * near), 6).alias("loss"), F.sum(near).cast("long").alias("near"))


@query("SELECT count(*) responses, round(-avg(m), 6) loss FROM (SELECT coalesce(sum(s_lp) FILTER (mask), 0)/greatest(count(*) FILTER (mask), 1) m FROM tokens GROUP BY sample_id)")
def sft_loss(spark, d):
    return tk.sft_loss(tokens(spark, d), "s_lp", ["sample_id"]).select("responses", r6("loss"))


@query("SELECT domain, round(avg(greatest(-exp(s_lp-old_lp)*adv, -least(greatest(exp(s_lp-old_lp), 0.8::DOUBLE), 1.2::DOUBLE)*adv) - 0.01::DOUBLE*abs(r) + 0.1::DOUBLE*(s_lp - t_lp)), 6) loss FROM tokens WHERE mask GROUP BY domain")
def policy_total(spark, d):
    loss, _ = tk.policy_loss(F.exp(F.col("s_lp") - F.col("old_lp")), F.col("adv"), 0.2, 0.2)
    total = tk.policy_total(loss, F.abs("r"), tk.approx_kl(F.col("s_lp"), F.col("t_lp"), "k1"), 0.01, 0.1)
    return tokens(spark, d).where("mask").groupBy("domain").agg(F.round(F.avg(total), 6).alias("loss"))


@query("SELECT sample_id, pos, round(ln((exp(t_lp) + 3*exp(s_lp))/4), 6) pooled FROM tokens")
def weighted_pool(spark, d):
    return tokens(spark, d).select("sample_id", "pos", F.round(tk.log_weighted_mean_exp(F.array("t_lp", "s_lp", "old_lp"), F.array(F.lit(0.25), F.lit(0.75), F.lit(0.0))), 6).alias("pooled"))


@query("SELECT sample_id, pos, round(CASE WHEN sample_id % 2 = 0 THEN t_lp ELSE s_lp END, 6) label, round(CASE WHEN s_lp < t_lp THEN s_lp ELSE t_lp END, 6) \"dynamic\", round(ln((exp(t_lp) + exp(s_lp))/2), 6) pool FROM tokens")
def teacher_targets(spark, d):
    scores = F.create_map(F.lit("a"), F.col("t_lp"), F.lit("b"), F.col("s_lp"))
    name = F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b")
    of = lambda mode: F.round(tk.teacher_target(mode, scores, name, scores)["target"], 6).alias(mode)
    return tokens(spark, d).select("sample_id", "pos", of("label"), of("dynamic"), of("pool"))


MASKS = "SELECT sample_id, list(mask::INT ORDER BY pos) m FROM tokens GROUP BY 1 HAVING bool_or(mask)"


@query(f"SELECT sample_id, len(m)::INT n, list_sum(m)::INT ones, (len(m) - list_position(m, 1) + 1)::BIGINT AS length FROM ({MASKS})")
def response_masks(spark, d):
    rows = tokens(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("mask").cast("int").alias("m"))))["m"].alias("m")).where(F.array_contains("m", 1))
    mask = tk.response_mask(F.col("m"), F.size("m"))
    return rows.select("sample_id", F.size(mask).alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("ones"), tk.response_length(F.col("m")).alias("length"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '-1' WHEN event_id % 5 = 1 THEN user_id || ',-1' ELSE '-1,' || event_id || ',-1' END ids FROM events", views=False)
def one_end_token(spark, d):
    end, kind = F.lit(-1).cast("long"), F.col("event_id") % 5
    ids = F.when(kind == 0, F.array(end, end)).when(kind == 1, F.array(F.col("user_id"), end, end)).otherwise(F.array(end, F.col("event_id")))
    return table(spark, d, "events").select("event_id", F.array_join(tk.one_end(ids, -1), ",").alias("ids"))


@query("SELECT sample_id, list_sort(list(pos) FILTER (m AND n))[1] - 1 AS first FROM (SELECT sample_id, pos, mask AND pos > 0 m, coalesce(lead(mask) OVER (PARTITION BY sample_id ORDER BY pos), false) = false AND lead(mask) OVER (PARTITION BY sample_id ORDER BY pos) IS NOT NULL n FROM tokens) GROUP BY sample_id")
def token_subsequence(spark, d):
    rows = tokens(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("mask").cast("int").alias("m"))))["m"].alias("m"))
    return rows.select("sample_id", F.get(tk.subsequence(F.col("m"), [1, 0]), F.lit(0)).alias("first"))


@query("SELECT lang, sum(4*(2.0::DOUBLE*n*64*4*16 + 4*n*64*2*16 + 2*n*n*4*16 + 2*n*4*16*64 + 6*n*64*256) + 2*n*64*1000) flops FROM (SELECT lang, n_chars::DOUBLE n FROM documents) GROUP BY lang", views=False)
def flops_sums(spark, d):
    flops = tk.forward_flops(F.col("n_chars"), 4, 64, 4, 2, 16, 256, 1000)
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(flops).alias("flops"))


@query("SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS json FROM events", views=False)
def canonical_keys(spark, d):
    both = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", text.canonical_json(both).alias("json"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages", views=False)
def page_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", text.netloc(F.col("url")).alias("host"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || '000' WHEN 1 THEN '\\frac{1}{' || user_id % 10 || '}' WHEN 2 THEN user_id::VARCHAR ELSE '5' || user_id END answer FROM events", views=False)
def final_answers(spark, d):
    n, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    said = F.when(kind == 0, F.concat(F.lit("x = "), n, F.lit(",000 dollars"))).when(kind == 1, F.concat(F.lit("$\\frac1"), (F.col("user_id") % 10).cast("string"), F.lit("$"))).when(kind == 2, F.concat(F.lit("\\text{"), n, F.lit("} cm"))).otherwise(F.concat(F.lit("it is $5"), n, F.lit("$ mph")))
    return table(spark, d, "events").select("event_id", answers.final_answer(said).alias("answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'x = ' || doc_id || chr(10) ELSE text END code FROM documents", views=False)
def fenced_code(spark, d):
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```python\nold```\n```python\nx = "), F.col("doc_id"), F.lit("\n``` and more"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", answers.fenced(said).alias("code"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN n > 31 THEN 0.8 ELSE 0 END ELSE 0 END::DOUBLE score FROM (SELECT doc_id, length(item) n FROM (SELECT doc_id, 'n' || doc_id || repeat('a', (doc_id % 60)::BIGINT) item FROM documents))", views=False)
def format_scores(spark, d):
    item = F.concat(F.lit("n"), F.col("doc_id"), F.repeat(F.lit("a"), (F.col("doc_id") % 60).cast("int")))
    kind = F.col("doc_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("<think>"), item, F.lit("</think> <answer>1</answer>"))).when(kind == 1, F.concat(F.lit("so it is "), item, F.lit(" = 1+2 = 3"))).otherwise(item)
    return table(spark, d, "documents").select("doc_id", answers.format_score(said, F.lit(None).cast("string"), F.when(kind == 1, "3")).alias("score"))


@query("SELECT doc_id, chr((65 + doc_id % 8)::INT) AS choice FROM documents", views=False)
def chosen_options(spark, d):
    c, other = F.char(65 + F.col("doc_id") % 8), F.char(65 + (F.col("doc_id") + 3) % 8)
    forms = [F.concat(c, F.lit(") because of it")), F.concat(F.lit("so i pick the one that is "), c), F.concat(F.lit("it is ("), c, F.lit(") then")), F.concat(F.lit("maybe "), other, F.lit(": no, the answer is "), c, F.lit(" and not "), other, F.lit(" so")), F.concat(F.lit("option "), c, F.lit(". yes; not "), other, F.lit("- though"))]
    said = F.get(F.array(*forms), (F.col("doc_id") % len(forms)).cast("int"))
    return table(spark, d, "documents").select("doc_id", answers.option(said).alias("choice"))


@query("SELECT event_id, event_id % 4 <> 3 same, '{\"v\":' || user_id || '}' || chr(10) || '{\"v\":' || event_id || '}' AS cases FROM events", views=False)
def compared_outputs(spark, d):
    n, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    lines = F.when(kind == 0, F.array(n, n)).when(kind == 1, F.array(F.concat(F.lit(" "), n, F.lit(" ")), n)).when(kind == 2, F.array(n, F.concat(n, F.lit(" \n")))).otherwise(F.array(n, F.lit("no")))
    truth = F.concat(n, F.lit("\n"), n, F.lit("\n"))
    return table(spark, d, "events").select("event_id", answers.same_output(lines, truth).alias("same"), text.case_text(F.array("user_id", "event_id")).alias("cases"))


@query(f"SELECT domain, round(avg(CASE WHEN t.sample_id % 10 = 1 THEN 0.25 ELSE t.adv * w END), 6) mean_advantage, count(*) FILTER (t.sample_id % 10 = 1) injected, round(any_value(w), 6) multiplier FROM tokens t JOIN (SELECT domain, {CLIP} w FROM ({MULT})) m USING (domain) WHERE mask GROUP BY domain")
def hook_batch(spark, d):
    # Multipliers measured and applied, constants injected over them, one line of the panel per domain.
    t = tokens(spark, d)
    m = nz.multipliers(nz.sufficient_stats(t))
    rows = nz.scaled(t, m).where("mask").withColumn("c", F.when(F.col("sample_id") % 10 == 1, 0.25).otherwise(0.0))
    f = rows.groupBy("domain").agg(F.avg(tk.injected(F.col("adv"), F.col("c"))).alias("mean_advantage"), F.count_if(F.col("c") > 0).alias("injected"))
    return f.join(m.select("domain", "multiplier"), "domain").select("domain", r6("mean_advantage"), "injected", r6("multiplier"))


@query("SELECT keep, count(*) n FROM (SELECT count(*) FILTER (CASE WHEN group_index % 3 = 0 THEN 0 ELSE reward END <> 0) > 0 keep FROM grp GROUP BY group_index) GROUP BY keep")
def nonzero_advantages(spark, d):
    rows = groups(spark, d).withColumn("adv", F.when(F.col("group_index") % 3 == 0, 0.0).otherwise(F.col("reward")))
    lists = rows.groupBy("group_index").agg(F.collect_list("adv").alias("adv"))
    return lists.groupBy(F.exists("adv", lambda x: x != 0).alias("keep")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) // 777 * 777 n, strftime(max(m) FILTER (r <= n), '%Y-%m-%d') AS last FROM (SELECT date_trunc('month', o_orderdate)::DATE m, row_number() OVER (ORDER BY date_trunc('month', o_orderdate)) r, count(*) OVER () // 777 * 777 n FROM orders)", views=False)
def trim_with_ties(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("m"))
    return gr.trimmed(o, ["m"], 777).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("m"), "yyyy-MM-dd").alias("last"))


# Responses as an update gets them, from the tokens of a user each. Scores are whole 64ths, so sums are exact in any order.
HOOK = """, u AS (SELECT sample_id, pos, CASE WHEN max(mask::INT) OVER (PARTITION BY sample_id) = 1 THEN mask ELSE true END ok, floor(t_lp*64)/64 a, floor(old_lp*64)/64 b, floor(s_lp*64)/64 s FROM tokens),
 m AS (SELECT sample_id i, count(*) len, avg(a) FILTER (ok) ma, avg(b) FILTER (ok) mb, CASE sample_id % 5 WHEN 0 THEN 'a_t' WHEN 1 THEN 'a_t' WHEN 2 THEN 'a_t' ELSE 'b_t' END applied,
  CASE sample_id % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'code' ELSE 'unknown' END dom, 'p' || (sample_id // 4) % 97 prompt, sample_id % 4 slot FROM u GROUP BY sample_id),
 e AS (SELECT i, dom, CASE WHEN applied = 'a_t' THEN a - s ELSE b - s END d FROM u JOIN m ON u.sample_id = m.i WHERE ok),
 f AS (SELECT dom, count(*) n, sum(d) s, sum(d*d) q FROM e GROUP BY dom), k AS (SELECT dom, {own} sd, {all} sd_all FROM f),
 r AS (SELECT m.*, CASE WHEN ma <= mb THEN 'a_t' ELSE 'b_t' END least, lag(applied) OVER (PARTITION BY prompt, slot ORDER BY i) was, (SELECT avg(d) FROM e WHERE e.i = m.i) delta FROM m) """.format(
    own=STD.format(n="n", s="s", q="q"), all=STD.format(n="sum(n) OVER ()", s="sum(s) OVER ()", q="sum(q) OVER ()")
)


def _hook_rows(spark, d):
    whole = lambda c: F.floor(F.col(c) * 64) / 64
    t = tokens(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("mask").cast("int").alias("m"), whole("t_lp").alias("a"), whole("old_lp").alias("b"), whole("s_lp").alias("s")))).alias("t"))
    i, mask = F.col("sample_id"), F.col("t.m")
    samples = t.select(
        i.alias("index"), F.concat(F.lit("p"), F.expr("sample_id div 4 % 97")).alias("prompt_sha256"), F.when(i % 3 == 0, "math").when(i % 3 == 1, "code").alias("domain"), F.when(i % 5 == 0, "").when(i % 5 == 2, "math").when(i % 5 > 2, "code").alias("label"),
        F.when(i % 7 == 0, "truncated").otherwise("completed").alias("status"), (i % 2 == 0).alias("correct"), F.when(F.array_max(mask) == 1, mask).alias("loss_mask"), F.col("t.s").alias("rollout_logp"), F.create_map(F.lit("a_t"), F.col("t.a"), F.lit("b_t"), F.col("t.b")).alias("scores"),
    )
    return hook.batch(samples, ["a_t", "b_t"], "label", {"math": "a_t", "code": "b_t"}, "a_t", 4, "dn")


@query(HOOK + f"SELECT i AS \"index\", applied, least current_argmin, was IS NOT NULL AS repeat, coalesce(was <> applied, false) switched, round(delta, 6) delta, round({CLIP}, 6) factor FROM r JOIN k USING (dom)")
def hook_audit(spark, d):
    return _hook_rows(spark, d).select("index", "applied", "current_argmin", "repeat", "switched", r6("rollout_delta_mean", "delta"), r6("dnorm_factor", "factor"))


@query(HOOK + "SELECT count(*) n, min(i) first_index, round(avg((applied = 'a_t')::INT), 6) share_a, 1.0::DOUBLE agreement, round(avg((applied <> least)::INT), 6) disagreement, count(was) repeats, round(count(*) FILTER (was <> applied) / count(was), 6) switch_rate, round(avg(len), 6) mean_length, round(avg((i % 7 = 0)::INT), 6) truncation, round(avg(delta) FILTER (dom = 'unknown'), 6) delta_unknown, round(avg((applied = 'b_t')::INT) FILTER (dom = 'math'), 6) share_b_math FROM r")
def hook_panel(spark, d):
    p = hook.panel(_hook_rows(spark, d))
    at = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0.0))
    shares = [F.round(at(F.col("share"), "a_t"), 6).alias("share_a"), r6("label_agreement", "agreement"), r6("shadow_argmin_disagreement", "disagreement"), F.col("repeat_prompts").alias("repeats"), r6("repeat_switch_rate", "switch_rate"), r6("mean_response_length", "mean_length"), r6("truncation_rate", "truncation")]
    return p.select("n", F.col("iteration_first_index").alias("first_index"), *shares, F.round(F.col("rollout_delta_by_domain")["unknown"]["mean_delta"], 6).alias("delta_unknown"), F.round(at(F.col("share_by_domain")["math"], "b_t"), 6).alias("share_b_math"))


# The permutation a round at a time; a place that lands outside the table goes on for as many rounds again.
PAGE = """WITH RECURSIVE d AS (SELECT n, hi, (n + hi - 1) // hi lo FROM (SELECT count(*) n, ceil(sqrt(count(*)))::BIGINT hi FROM orders)),
 s AS (SELECT n * 2 // 3 + unnest(range(n * 2 // 3)) step FROM d),
 w AS (SELECT step, step // n epoch, step % n slot, step % n // lo a, step % n % lo b, 0 i FROM s, d UNION ALL
 SELECT step, epoch, slot, CASE WHEN i % 2 = 1 THEN a ELSE (a + f) % hi END, CASE WHEN i % 2 = 1 THEN (b + f) % lo ELSE b END, i + 1
 FROM (SELECT *, (t2 * t2 % 2147483647 * 48271 + v) % 2147483647 f FROM (SELECT *, (t1 * t1 + t1) % 2147483647 t2 FROM (SELECT *, (v + (11 * 1000003 + epoch * 7919 + i % 6 * 104729) % 2147483647) % 2147483647 t1
 FROM (SELECT w.*, n, hi, lo, CASE WHEN i % 2 = 1 THEN a ELSE b END v FROM w, d WHERE i = 0 OR i % 6 > 0 OR a * lo + b >= n)))))
 SELECT o_orderkey, step, epoch, slot FROM w, d, (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 p FROM orders) o WHERE i > 0 AND i % 6 = 0 AND a * lo + b < n AND p = a * lo + b"""


@query(PAGE, views=False)
def epoch_page(spark, d):
    # The last third of one epoch and the first of the next: places in orders of their own.
    o = table(spark, d, "orders").select("o_orderkey")
    index = ranges.ranges(o, ["o_orderkey"])
    return ranges.page(index, 11, index.total * 2 // 3, index.total * 2 // 3).select("o_orderkey", "step", "epoch", "slot")


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) by_text, o_orderkey % 5 IN (0, 1, 3) by_value FROM orders", views=False)
def answer_values(spark, d):
    # A fraction as such, with a slash, not reduced, as a mixed number, and another one.
    a, b, k = F.col("o_custkey") % 400 + 1, F.col("o_orderkey") % 12 + 1, F.col("o_orderkey") % 5
    frac = lambda x, y: F.concat(F.lit("\\frac{"), x.cast("string"), F.lit("}{"), y.cast("string"), F.lit("}"))
    mixed = F.concat(F.floor(a / b).cast("string"), F.lit(" "), (a % b).cast("string"), F.lit("/"), b.cast("string"))
    given = F.when(k == 0, frac(a, b)).when(k == 1, F.concat(a.cast("string"), F.lit("/"), b.cast("string"))).when(k == 2, frac(a * 2, b * 2)).when(k == 3, mixed).otherwise(frac(a + 1, b))
    rows = table(spark, d, "orders").select("o_orderkey", given.alias("given"), frac(a, b).alias("truth"))
    return values.compared(rows, "given", "truth").select("o_orderkey", "by_text", "by_value")


@query()
def constraint_prompts(spark, d):
    # As many prompts as there are parts, each about one of them.
    parts = table(spark, d, "part").select("p_name")
    made = constraints.generated(parts, "p_name", parts.count(), 5)
    return made.select("row", F.col("base").alias("p_name"), "prompt", F.size("specs").alias("constraints"), "empty_fails")
