"""The update's plan against a plain reading of its rules, and runs that stop and go on."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import hook
from braidwork.streaming import commits, resume

NAMES = ["code_t", "math_t", "chat_t"]
ROUTE = {"math": "math_t", "code": "code_t"}
SCHEMA = "index long, prompt_sha256 string, domain string, label string, status string, correct boolean, loss_mask array<int>, rollout_logp array<double>, scores map<string,array<double>>"


def make(n, seed=0, first=0, prompts=3, slots=4):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        length = rng.randint(1, 6)
        score = lambda: [-rng.random() * 4 for _ in range(length)]  # noqa: E731, B023
        mask = None if rng.random() < 0.3 else [1] + [rng.randint(0, 1) for _ in range(length - 1)]
        rows.append((i, f"p{i // slots % prompts}", rng.choice(["math", "code", None]), rng.choice(["math", "code", "", None, "chat_t"]), rng.choice(["completed", "truncated"]), rng.random() < 0.5, mask, score(), {t: score() for t in NAMES}))
    return rows


def by_force(rows, mode, slots, known, scale=None):
    """Audit rows as dictionaries, in the order of samples."""
    last, out, deltas = dict(known), [], {}
    for index, prompt, domain, label, status, _, mask, rollout, scores in sorted(rows):
        on = mask or [1] * len(rollout)
        mean = {t: sum(x for x, m in zip(s, on, strict=True) if m) / sum(on) for t, s in scores.items()}
        least = min(sorted(mean), key=lambda t: mean[t])
        routed = ROUTE.get(label, label) if label else "chat_t"
        applied = {"label": routed, "dynamic": least, "pool": "pool"}[mode]
        target = [math.log(sum(math.exp(scores[t][k]) for t in NAMES) / 3) for k in range(len(rollout))] if mode == "pool" else scores[applied]
        delta = [a - b for a, b, m in zip(target, rollout, on, strict=True) if m]
        tracked = least if mode == "pool" else applied
        before = last.get((prompt, index % slots))
        last[prompt, index % slots] = tracked
        deltas.setdefault(domain or "unknown", []).extend(delta)
        out.append({"index": index, "applied": applied, "current_argmin": least, "label_teacher": routed, "repeat": before is not None, "switched": before is not None and before != tracked, "delta": sum(delta) / len(delta), "domain": domain or "unknown", "length": len(rollout), "cut": status == "truncated", "tracked": tracked})
    if scale:
        sd = lambda v: math.sqrt(max(0.0, sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2))
        every = sd([x for v in deltas.values() for x in v])
        for r in out:
            own = sd(deltas[r["domain"]])
            r["factor"] = min(4.0, max(0.25, every / own)) if own > 0 and every > 0 else 1.0
    return out


@pytest.mark.parametrize(("mode", "scale"), [("label", "dn"), ("label", None), ("dynamic", None), ("pool", None)])
def test_batches(spark, mode, scale):
    rows = make(90, seed=5)
    known = {("p0", 1): "math_t", ("p2", 3): "chat_t"}
    before = spark.createDataFrame([(*k, -1, t) for k, t in known.items()], "prompt_sha256 string, slot int, index long, teacher string")
    got = hook.batch(spark.createDataFrame(rows, SCHEMA).repartition(5), NAMES, mode, ROUTE, "chat_t", 4, scale, known=before)
    want = by_force(rows, mode, 4, known, scale)
    found = got.orderBy("index").collect()
    assert [(r["index"], r.applied, r.current_argmin, r.label_teacher, r.repeat, r.switched, r.response_length) for r in found] == [(w["index"], w["applied"], w["current_argmin"], w["label_teacher"], w["repeat"], w["switched"], w["length"]) for w in want]
    assert all(abs(r.rollout_delta_mean - w["delta"]) < 1e-9 for r, w in zip(found, want, strict=True))
    if scale:
        assert all(abs(r.dnorm_factor - w["factor"]) < 1e-9 and r.dnorm_measured_factor == r.dnorm_factor for r, w in zip(found, want, strict=True))
    p = hook.panel(got).first()
    n, again = len(want), [w for w in want if w["repeat"]]
    assert p.n == n and p.iteration_first_index == 0 and abs(p.repeat_switch_rate - sum(w["switched"] for w in again) / len(again)) < 1e-12
    assert abs(p.share["math_t"] - sum(w["tracked"] == "math_t" for w in want) / n) < 1e-12 and abs(p.truncation_rate - sum(w["cut"] for w in want) / n) < 1e-12
    assert abs(p.label_agreement - sum(w["tracked"] == w["label_teacher"] for w in want) / n) < 1e-12 and (p.shadow_argmin_disagreement is None) == (mode == "pool")
    code = [w for w in want if w["domain"] == "code"]
    assert p.rollout_delta_by_domain["code"].n == len(code) and abs(p.rollout_delta_by_domain["code"].mean_delta - sum(w["delta"] for w in code) / len(code)) < 1e-9
    assert abs(sum(p.share_by_domain["unknown"].values()) - 1) < 1e-12


def test_scales_that_are_given(spark):
    rows = spark.createDataFrame([(*r[:2], r[2] or "chat", *r[3:]) for r in make(40, seed=2)], SCHEMA)
    fixed = {"math": 2.0, "code": 1.0, "chat": 0.25}
    got = hook.batch(rows, NAMES, "label", ROUTE, "chat_t", 4, "fixed", fixed).collect()
    assert all(r.dnorm_factor == fixed[r.domain] for r in got) and len({r.dnorm_measured_factor for r in got}) == 3
    assert {r.dnorm_factor for r in hook.batch(rows, NAMES, "label", ROUTE, "chat_t", 4, "observe").collect()} == {1.0}
    with pytest.raises(ValueError):
        hook.batch(rows, NAMES, "pool", ROUTE, "chat_t", 4, "dn")


def test_injections(spark):
    rows = make(24, seed=3, prompts=6)
    rows = [(*r[:2], "math", *r[3:]) for r in rows]
    bank = spark.createDataFrame([("p1", "math", 2, [-0.5, -0.25]), ("p4", "math", 1, [-1.0]), ("p9", "code", 1, [-1.0])], "prompt_sha256 string, bank_domain string, bank_length int, bank_logp array<double>")
    samples = spark.createDataFrame(rows, SCHEMA)
    step, c = hook.injection_step(samples, 0.4, 10.0, 24)
    assert (step, c) == (0, 0.4) and hook.injection_step(samples.withColumn("index", F.col("index") + 240), 0.4, 10.0, 24)[1] == 0.0
    got = hook.batch(samples, NAMES, "label", ROUTE, "chat_t", 4, bank=bank, constant=c)
    want = set()
    for g in (1, 4):
        own = sorted((r[5], r[0]) for r in rows if r[0] // 4 == g)
        want.add(own[0][1])
    found = {r["index"]: r for r in got.collect()}
    assert {i for i, r in found.items() if r.injected} == want and {r.inject_adv_const for r in found.values()} == {0.0, 0.4}
    assert all(r.rollout_delta_mean == 0.0 and r.response_length in (1, 2) for r in found.values() if r.injected)
    assert hook.panel(got).first().injected_by_domain == {"math": 2}
    unsure = spark.createDataFrame([(*r[:5], None if r[0] == 5 else r[5], *r[6:]) for r in rows], SCHEMA)
    with pytest.raises(Exception, match="no verdict of sample"):
        hook.batch(unsure, NAMES, "label", ROUTE, "chat_t", 4, bank=bank, constant=c).collect()
    assert not any(r.injected for r in hook.batch(unsure, NAMES, "label", ROUTE, "chat_t", 4, bank=bank, constant=0.0).collect())
    with pytest.raises(ValueError):
        hook.injection_step(samples.where("index > 2"), 0.4, 10.0, 24)


@pytest.mark.parametrize(("change", "says"), [({"scores": {"math_t": [-1.0]}}, "teachers of sample"), ({"scores": {t: [-1.0, float("nan")] for t in NAMES}}, "scores of sample"), ({"scores": {t: [hook.SENTINEL] for t in NAMES}}, "scores of sample"), ({"scores": None}, "teachers of sample"), ({"loss_mask": [0], "scores": {t: [-1.0] for t in NAMES}}, "mask of sample"), ({"label": "nobody"}, "unregistered teacher"), ({"scores": {t: [] for t in NAMES}}, "scores of sample")])
def test_what_is_not_whole_is_an_error(spark, change, says):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    row = dict(zip(names, make(1)[0], strict=True)) | change
    with pytest.raises(Exception, match=says):
        hook.batch(spark.createDataFrame([tuple(row[c] for c in names)], SCHEMA), NAMES, "label", ROUTE, "chat_t", 4).collect()


def test_memory_of_audit_rows(spark):
    rows = [(0, "label", "p", 0, 0, "a", "z"), (0, "label", "p", 0, 4, "b", "z"), (1, "label", "p", 0, 4, "c", "z"), (1, "label", "p", 0, 8, "d", "z"), (1, "label", "q", 1, 5, "e", "z")]
    audit = spark.createDataFrame(rows, "update long, mode string, prompt_sha256 string, slot int, index long, applied string, current_argmin string")
    assert sorted(map(tuple, hook.memory(audit, 8, "label").collect())) == [("p", 0, 4, "c"), ("q", 1, 5, "e")]
    with pytest.raises(Exception, match="audit rows of mode"):
        hook.memory(audit, 8, "pool").collect()


def lines(folder, number, rows):
    """A file of JSON lines; later numbers are later files."""
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_000_000 + 100 * number,) * 2)


def streamed(spark, folder, schema, make_stream, checkpoint):
    """The rows that a stream over the files of a folder gives, one file a batch, until all are read."""
    got = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make_stream(source).writeStream.outputMode("append").foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def test_switches_go_on_from_audit_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [{"prompt_sha256": f"p{i // 4 % 3}", "slot": i % 4, "index": i, "teacher": rng.choice("ab")} for i in range(48)]
    schema = "prompt_sha256 string, slot int, index long, teacher string"
    whole, rest = tmp_path / "whole", tmp_path / "rest"
    whole.mkdir(), rest.mkdir()
    for k in range(4):
        lines(whole, k, rows[12 * k : 12 * k + 12])
        if k >= 2:
            lines(rest, k, rows[12 * k : 12 * k + 12])
    through = streamed(spark, whole, schema, resume.teacher_switches, tmp_path / "c1")
    # The run broke off within its third batch, whose first rows were audited, and is begun anew at sample 24.
    audit = spark.createDataFrame([(r["index"] // 12, "label", r["prompt_sha256"], r["slot"], r["index"], r["teacher"], "x") for r in rows[:29]], "update long, mode string, prompt_sha256 string, slot int, index long, applied string, current_argmin string")
    memory = hook.memory(audit, 24, "label")
    resumed = streamed(spark, rest, schema, lambda s: resume.teacher_switches(s, memory), tmp_path / "c2")
    assert sorted(resumed) == sorted(r for r in through if r[0] >= 24) and any(r[6] for r in resumed)
    assert sorted(r[0] for r in streamed(spark, rest, schema, resume.teacher_switches, tmp_path / "c3") if not r[5]) != sorted(r[0] for r in resumed if not r[5])


def test_frozen_multipliers_go_on_from_audit_rows(spark, tmp_path):
    rows = [{"step": s, "domain": d, "multiplier": 1.0 + s / 8 + k, "measurable": s >= k} for s in range(6) for k, d in enumerate(("math", "code", "chat", "ifeval"))]
    rows = [r if r["domain"] != "ifeval" else {**r, "measurable": r["step"] == 4} for r in rows]
    schema = "step long, domain string, multiplier double, measurable boolean"
    whole, rest = tmp_path / "whole", tmp_path / "rest"
    whole.mkdir(), rest.mkdir()
    for s in range(6):
        for folder in (whole, rest) if s >= 3 else (whole,):
            lines(folder, s, [r for r in rows if r["step"] == s])
    through = streamed(spark, whole, schema, resume.frozen_multipliers, tmp_path / "c1")
    audit = spark.createDataFrame([tuple(r.values()) for r in rows if r["step"] <= 4], schema)
    resumed = streamed(spark, rest, schema, lambda s: resume.frozen_multipliers(s, resume.frozen_from(audit, 3)), tmp_path / "c2")
    assert sorted(resumed, key=str) == sorted((r for r in through if r[0] >= 3), key=str)
    assert {(r[1], r[2], r[3]) for r in through if r[0] == 5} == {("math", 1.0, 0), ("code", 2.125, 1), ("chat", 3.25, 2), ("ifeval", 4.5, 4)}
    assert {r[2] for r in through if r[1] == "ifeval" and r[0] < 4} == {4.0, 4.125, 4.25, 4.375}


def test_partial_samples_wait_in_their_own_state(spark, tmp_path):
    steps = [[(1, "partial"), (2, "completed")], [(1, "partial"), (3, "truncated"), (4, "partial")], [(1, "completed"), (4, "aborted")]]
    folder = tmp_path / "in"
    folder.mkdir()
    for s, rows in enumerate(steps):
        lines(folder, s, [{"run": "r", "step": s, "index": i, "status": x} for i, x in rows])
    got = streamed(spark, folder, "run string, step long, index long, status string", resume.partial_buffer, tmp_path / "c")
    assert sorted(got) == [("r", 1, 0, 2, True), ("r", 2, 0, 0, False), ("r", 3, 1, 1, False)]


def test_an_update_that_fails_after_its_write_is_there_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for u in range(3):
        lines(folder, u, [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in make(12, seed=u, first=12 * u)])
    log = commits.UpdateLog(spark, str(tmp_path / "run"))
    broken = [True]

    class Failing(commits.UpdateLog):
        def commit(self, update, tables):
            if update == 1 and broken:
                for name, df in tables.items():
                    df.write.mode("overwrite").parquet(f"{self.root}/{name}/update={update}")
                raise RuntimeError("lost after the write")
            return super().commit(update, tables)

    def tables(df, number):
        rows = hook.batch(df, NAMES, "label", ROUTE, "chat_t", 4, "dn", known=hook.memory(log.read("audit"), 12 * number, "label") if log.committed() else None)
        return {"audit": rows, "panel": hook.panel(rows)}

    def run(kind):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        commits.updates(stream, kind(spark, log.root), tables, str(tmp_path / "c")).awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        run(Failing)
    assert log.committed() == [0] and log.read("audit").count() == 12
    broken.clear()
    run(Failing)
    assert log.committed() == [0, 1, 2] and sorted(r["index"] for r in log.read("audit").collect()) == list(range(36))
    assert log.read("panel").count() == 3 and log.read("panel").agg(F.sum("n")).first()[0] == 36
    want = [w for u in range(3) for w in by_force(make(12, seed=u, first=12 * u), "label", 4, {})]
    assert {r["index"]: r.applied for r in log.read("audit").collect()} == {w["index"]: w["applied"] for w in want}
    every = by_force([r for u in range(3) for r in make(12, seed=u, first=12 * u)], "label", 4, {})
    assert {r["index"]: (r.repeat, r.switched) for r in log.read("audit").collect()} == {w["index"]: (w["repeat"], w["switched"]) for w in every}
    assert not log.commit(2, {})
