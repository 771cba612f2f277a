"""The operators in Spark over small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_kernels import repeats_by_force

from braidwork.llm import fingerprint, license, lm, mixing, near, packing, pii, queries, repeats, search, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _plan string, tox_score double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randint(0, 60)) for _ in range(n))
    base = [text(rng.randint(5, 90)) for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 4}", len(t), "x", 0.5) for i, t in enumerate(base)]
    rows += [(40, base[3], None, None, None, None, None), (41, base[4].replace("the", "thee", 1) + " end", None, "src0", 1, None, None)]
    rows += [(42, None, "en", None, None, None, None), (43, "", "en", "src1", 0, "x", 0.0), (44, "", None, "src1", 0, None, None), (None, text(20), None, None, None, None, None)]
    rows += [rows[5], rows[5], (45, text(9000), "en", "src2", 1, None, None), (46, "\n\n", "en", "src2", 2, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _columns(df):
    return [r.asDict() for r in df.collect()]


def test_every_query_runs_over_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in {"labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, f in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_mixing_targets_and_takes(docs):
    got = mixing.takes(docs, block=8).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and (r["size"] or not r.taken)
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5 + 1e-6 and rs[0].target <= 3 * rs[0].source_size + 1e-9
    again = mixing.takes(docs.repartition(5), block=8).collect()
    key = lambda rs: sorted((str(r.doc_id), r.mix, r.taken) for r in rs)
    assert key(got) == key(again)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("text is null or text = ''").count() == 0


def mix_targets(sizes):
    """Targets by pouring: weights 1, 2, 3 in the order of names, a source filled at three times its size gives the rest back."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), [s for s in names if sizes[s]], float(sum(sizes.values()))
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += level * weight[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
        open_ = [s for s in open_ if target[s] < 3 * sizes[s] - 1e-9]
    return target


def test_mixing_gives_small_sources_their_targets(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [(i, words(500, "big"), "a") for i in range(40)] + [(50, words(65, "small"), "b"), (51, words(3, "tiny"), "c"), (52, words(20, "none"), None), (53, words(7, "d"), "d"), (53, words(7, "d"), "d"), (54, "", "e")]
    got = mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = mix_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    slots = mixing.schedule(spark.createDataFrame([(s, sizes[s], want[s]) for s in sizes], "source string, source_size long, target double"), 100_000).collect()
    first = [r.source for r in sorted(slots, key=lambda r: r.slot)[:100]]
    assert len(slots) == -(-100_000 // mixing.BLOCK) and abs(first.count("a") / 100 - want["a"] / sum(want.values())) < 0.02


def test_the_schedule_decides_the_mix(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{rng.choice('aaaabbc')}", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank long").repartition(4)
    whole = mixing.takes(docs, block=8).collect()
    goal = {r.source: r.target for r in whole}
    total, share = sum(goal.values()), lambda rs: {s: sum(r.taken for r in rs if r.source == s) for s in goal}
    assert all(abs(n - goal[s]) <= 0.5 for s, n in share(whole).items())
    for part in (0.1, 0.35, 0.7):  # every beginning of the mix is near the weights, by blocks of some words
        until = int(part * total / 8)
        cut = mixing.takes(docs, block=8, until=until).collect()
        assert all(abs(n - part * goal[s]) < 8 * 6 for s, n in share(cut).items())
        assert all((r.first_slot is None) == (r.taken == 0) and (r.first_slot is None or r.first_slot < until) for r in cut)
    # The rows come in the order of slots, each source's in that of its stream, so their beginnings are mixed to weight too.
    length, where = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[2] for r in rows}
    order = [r.doc_id for r in mixing.mixed(docs, block=8).collect()]
    assert set(order) == {r.doc_id for r in whole if r.taken >= r["size"] / 2 and r["size"]}
    for part in (0.2, 0.5, 0.8):
        met, words = {s: 0 for s in goal}, 0
        for i in order:
            if words >= part * total:
                break
            met[where[i]] += length[i]
            words += length[i]
        assert all(abs(n - part * goal[s]) < 0.03 * total for s, n in met.items())
    # Consecutive slots in place of the golden ratio: another mix.
    firsts = {r.doc_id: r.first_slot for r in whole}
    plain = mixing.schedule

    def lined_up(goals, total, block):
        from pyspark.sql import Window

        made = plain(goals, total, block).drop("slot")
        return made.withColumn("slot", (F.row_number().over(Window.orderBy("source", "rank")) - 1).cast("long"))

    monkeypatch.setattr(mixing, "schedule", lined_up)
    again = mixing.takes(docs, block=8).collect()
    assert {r.doc_id: r.first_slot for r in again} != firsts
    half = share(mixing.takes(docs, block=8, until=int(total / 16)).collect())
    assert max(abs(n - goal[s] / 2) for s, n in half.items()) > 0.1 * total


def test_packing_places_every_row(docs):
    got = packing.packed(docs, buckets=4, budget=200).collect()
    assert len(got) == docs.count() and all(r["size"] <= r.width for r in got)
    seen = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(seen) == len(got) and all((r.slot + 1) * r.width <= max(200, r.width) for r in got)


def test_pii_report(docs):
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    marked = docs.withColumn("text", F.concat(F.col("text"), F.lit(" a@b.cc")))
    out = pii.redacted(marked)
    assert out.columns == docs.columns and out.where("text like '%<email>'").count() == marked.where("text is not null").count()


def test_pii_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(21)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: "".join(x for x in t if x in "0123456789")
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    )
    pool = ["a@b.cc", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "411111111111111", "+49 30 123456", "+1 (555) 010-9999", "+1", ".", " ", "-", "é中", "word ", "12", "\n"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [(k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k, *_ in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_fingerprint_likeness_follows_the_cosine_of_triples(spark):
    def triples(text):
        out = {}
        for line in text.split("\n"):
            w = re.split(r"[\x20\x09-\x0D]+", line)
            for i in range(max(1, len(w) - 2)):
                out[tuple(w[i : i + 3])] = out.get(tuple(w[i : i + 3]), 0) + 1
        return out

    def cosine(a, b):
        dot = sum(n * b.get(k, 0) for k, n in a.items())
        return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5

    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    ids, gaps = sorted(texts, reverse=True), []
    after = {i: texts[j] for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}
    for r in fingerprint.report(d).collect():
        t = texts[r.doc_id]
        edited = t[: len(t) - len(t) // 2] + after[r.doc_id][: len(t) // 2]
        gaps += [abs(r.near_edited - max(0.0, cosine(triples(t), triples(edited)))), abs(r.near_next - max(0.0, cosine(triples(t), triples(after[r.doc_id]))))]
    assert sum(gaps) / len(gaps) < 0.1 and max(gaps) < 0.5


def test_fingerprints(docs):
    rows = fingerprint.report(docs).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.text or "", []).append(r.doc_id)
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[3] == prints[40] and prints[42] == prints[43] == prints[44] and len(prints[5]) == 1


def test_fingerprints_edit_and_order(spark):
    rows = [(1, "abcdef"), (2, "xy"), (3, "0123456789"), (5, "é中文")]
    got = {r.doc_id: r for r in fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, after = dict(rows), {5: 3, 3: 2, 2: 1, 1: 5}
    for i, t in rows:
        k = len(t) // 2
        edited = t[: len(t) - k] + text[after[i]][:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    one = fingerprint.report(spark.createDataFrame([(7, "solo text")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_fingerprints_add_and_take_away(spark):
    def prints(text):
        df = spark.createDataFrame([(1, text)], "id long, text string")
        return fingerprint.fingerprints(df, ["id"], "text", []).select(fingerprint.as_text().alias("f")).first().f

    a, b, both, turned = (prints(t) for t in ("one two three four", "five six\nseven", "one two three four\nfive six\nseven", "seven\none two three four\nfive six"))
    df = spark.createDataFrame([(a, b, both)], "a string, b string, c string")
    r = df.select(fingerprint.combined(F.col("a"), F.col("b")).alias("sum"), fingerprint.combined(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert r.sum == both == turned and r.rest == a and a != b


def test_repeats_report(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {}
    for r in repeats.report(docs).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    copy = got[(40, len(dict(rows)[40]))][0]
    assert copy.n_removed == copy.n_bytes or copy.n_bytes < repeats.LENGTH
    assert len({(r.n_removed, r.kept_sha256) for r in got[(5, len(dict(rows)[5]))]}) == 1


@pytest.mark.parametrize("hot", [3, 512])
def test_repeats_report_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passages = [text(150), text(400), text(101)]
    rows = [(i, text(rng.randint(0, 90)) + rng.choice(passages) + text(rng.randint(0, 90)) + rng.choice(passages)) for i in range(60)]
    rows += [(3, rows[9][1]), (3, text(200)), (None, rows[11][1]), (None, None), (90, ""), rows[20]]  # one id with three texts
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    each = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want = {r: left for r, left in zip(each, repeats_by_force([t.encode() for _, t in each]), strict=True)}
    assert len(got) == len(rows)
    plain = []
    for i, t in rows:
        left, data = want[i, t or ""], (t or "").encode()
        plain.append((i, len(data), len(data) - len(left), hashlib.sha256(left).hexdigest()))
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=str) == sorted(plain, key=str)


def test_near_groups(docs):
    rows = near.report(docs).collect()
    assert len(rows) == docs.count()
    group = {}
    for r in rows:
        group.setdefault(r.doc_id, set()).add(r.group_id)
    assert group[3] == group[40] and group[4] == group[41] and group[42] == group[43] == group[44] and group[1] != group[2]
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({g for gs in group.values() for g in gs})


def test_near_recall_on_the_small_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    group = {r.doc_id: r.group_id for r in near.report(d).collect()}
    words = {r.doc_id: near.words(r.text) for r in d.collect()}
    ids, linked, met = sorted(words), 0, 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b]), 1) and near.similar(words[a], words[b]):
                linked += 1
                met += group[a] == group[b]
    assert met >= 0.95 * linked


def test_near_joins_a_hub_with_all_its_spokes(spark):
    rng = random.Random(8)
    hub = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    rows = [(0, " ".join(hub))]
    for i in range(1, 601):  # 0.88 to the hub, about 0.77 to each other; some shorter and some longer than it
        v = list(hub)
        for at in rng.sample(range(200), 24 if i % 3 else 22):
            v[at] = f"v{rng.randint(0, 99999)}"
        rows.append((i, " ".join(v if i % 3 else v[:-2] if i % 2 else [*v, "more", "words"])))
    rows += [(2000 + i, " ".join([*hub[:40], *(f"u{rng.randint(0, 99999)}" for _ in range(160))])) for i in range(200)]  # a common passage
    got = {r.doc_id: r.group_id for r in near.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] == 0 for i in range(601)) >= 600
    assert all(got[i] == i for i in range(2000, 2200))


def test_near_short_texts_join_exactly(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):  # one changed middle word in 6 to 15
        w = [f"w{rng.randint(0, 9999)}" for _ in range(6 + i % 10)]
        v = [*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r.doc_id: r.group_id for r in near.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(60))


def test_licences(spark, docs):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, "the license of the bar"), (4, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0."), (1, "x\nReleased under the MIT License.\ny"), (5, ""), (6, "word " * 30_000 + "\nReleased under GPLv3")]
    got = sorted((r.doc_id, r.families, r.lines) for r in license.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "mit", "1:mit"), (1, "mit", "1:mit"), (2, "", ""), (3, "", ""), (4, "cc-by,cc-by-nc", "0:cc-by-nc,2:cc-by"), (5, "", ""), (6, "gpl", "1:gpl")]
    assert license.report(docs).count() == docs.count()


def test_licences_wrapped_tagged_and_short(spark):
    said = {
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or": "gpl",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice": "isc",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "you can redistribute it under the GNU GPL v3": "gpl", "Distributed under the LGPL": "lgpl", "Licensed under the EUPL, Version 1.2": "eupl",
        "Distributed under the Boost Software License, Version 1.0.": "boost", "Der Text ist mit und ohne": "", "He lost his driving license in the car": "", "The software was free.": "",
    }
    got = license.report(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    assert {list(said)[r.doc_id]: r.families for r in got} == said


def test_licences_of_planted_lines(spark):
    planted = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "proprietary"}
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted({planted[x] for x in (r.text or "").split("\n") if x in planted})) for r in d.collect()}
    got = {r.doc_id: r.families for r in license.report(d).collect()}
    assert sum(1 for f in want.values() if f) > 10 and got == want


def test_search_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    got = {}
    for r in search.report(d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    import math

    parts = {r.doc_id: search._terms(r.text) for r in d.collect()}
    n, mean = len(parts), sum(p[2] for p in parts.values()) / len(parts)
    df = {}
    for t, _, _ in parts.values():
        for x in t.tolist():
            df[x] = df.get(x, 0) + 1
    for q in [i for i in parts if i % 50 == 0]:
        scores = []
        for i, (t, c, length) in parts.items():
            w = dict(zip(t.tolist(), c.tolist(), strict=True))
            s = sum(m * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w[x] * 2.2 / (w[x] + 1.2 * (0.25 + 0.75 * length / mean)) for x, m in zip(parts[q][0].tolist(), parts[q][1].tolist(), strict=True) if x in w)
            if s > 0:
                scores.append((-round(s, 6), i))
        assert [i for _, i in sorted(scores)[:10]] == [i for i, _ in got[q]]


def test_search_handles_nulls_and_copies(docs):
    rows = search.report(docs).collect()
    assert {r.query_id for r in rows} == {0} and rows


def test_search_joins_the_rows_of_a_query_and_ranks_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 3)  # a set for nearly each query
    rows = [(100, "one two"), (100, "three"), (100, "one two"), (50, "one two three"), (None, "one two three"), (7, "one two three"), (3, "x " * 50_000 + "three"), (None, None), (150, "")]
    got = {}
    for r in search.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {50, 100} and got[50] == got[100]  # the words of both rows of 100
    assert [d for d, _ in got[100]] == [7, 50, None, 100, 100, 100, 3] and len({s for _, s in got[100][:3]}) == 1


def test_lm_base_is_exact_and_scores_are_finite(docs, monkeypatch):
    monkeypatch.setattr(lm, "START", 200)
    rows = lm.report(docs).collect()
    assert len(rows) == docs.count()
    count, kinds = {}, docs.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
    for r in kinds:
        if not held(r):
            for w in [*(r.text or "").lower().split(), None]:
                count[w] = count.get(w, 0) + 1
    import math

    total, distinct = sum(count.values()), len(count)
    base = {}
    for r in kinds:
        tokens = [*(r.text or "").lower().split(), None]
        base[(r.doc_id, len(tokens))] = sum(math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
    for r in rows:
        assert math.isfinite(r.score) and r.score < 0 and r.train_tokens == total
        assert math.isclose(r.base_score, base[(r.doc_id, r.n_tokens)], rel_tol=1e-9)


def test_lm_learns_from_the_windows_of_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "START", 10)
    tables, write = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    rows = [(i, f"word{i % 7}") for i in range(2000)]  # a window each
    assert lm.report(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2000
    assert tables["lm-windows"].agg(F.sum("n")).first()[0] == sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.0), ("sf0.01", 0.02), ("sf0.1", 0.1)])
def test_lm_beats_its_base_on_texts_it_has_not_seen(spark, sf, least):
    rows = lm.report(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    assert all(r.score >= r.base_score + math.log10(lm.PRIOR[0]) - 1e-6 for r in rows)
    for own in ([r for r in rows if r.held_out], [r for r in rows if not r.held_out]):
        n = sum(r.n_tokens for r in own)
        assert sum(r.score for r in own) / n > sum(r.base_score for r in own) / n + least


def test_lm_is_the_same_for_any_split(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "START", 50)
    monkeypatch.setattr(lm, "GROUP", 300)  # several groups, averaged
    monkeypatch.setattr(lm, "TAKEN", 64)
    score = lambda df: {(r.doc_id, r.n_tokens): r.score for r in lm.report(df).collect()}
    one, two = score(docs.coalesce(1)), score(docs.repartition(6))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-3, abs_tol=0.01) for k in one)


def test_lm_mixtures():
    import numpy as np

    model, base = np.array([-1.0, -400.0, -3.0, -2.0]), np.array([-2.0, -5.0, -3.0, -330.0])
    got = lm.mixtures(model, base)
    for i, share in enumerate(lm.SHARES):
        want = [math.log10(share * 10**m + (1 - share) * 10**b) if share * 10**m + (1 - share) * 10**b > 0 else None for m, b in zip(model, base, strict=True)]
        assert all(w is None or abs(g - w) < 1e-9 for g, w in zip(got[:, i], want, strict=True))
    assert got[3, 0] < -290 and got[1, 0] == -5.0


def test_toxicity_report_handles_nulls_and_clashing_names(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(30)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_toxicity_finds_the_toxic_rows_that_taught_nothing(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    rows = [r for r in toxicity.report(d, labels).where("held_out").collect() if r.doc_id in toxic]
    caught = [r.predicted for r in rows if toxic[r.doc_id]]
    clean = [r.predicted for r in rows if not toxic[r.doc_id]]
    assert len(caught) > 30 and sum(caught) >= 0.8 * len(caught) and sum(clean) <= 0.02 * len(clean)


def test_pipeline_equals_its_stages_and_keeps_clean_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "pii", "mixing", "packing"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in d.collect()}
    kept = corpus_pipeline.drop_toxic(spark, d, SF)
    assert kept.columns == d.columns
    left = near.written(kept, "test-kept")
    gone = set(rows) - {r.doc_id for r in left.collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in gone for i in clean) <= 0.1 * len(clean)
    # One document of each group stays, the one with the least id.
    single = near.written(corpus_pipeline.drop_near_copies(spark, left, SF), "test-single")
    groups = {}
    for r in near.report(left).collect():
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    assert {r.doc_id for r in single.collect()} == {min(g) for g in groups.values()}
    masked = near.written(corpus_pipeline.mask_private(spark, single, SF), "test-masked")
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: pii.redact(r.text) for r in single.collect()}
    mixed = near.written(corpus_pipeline.mix_sources(spark, masked, SF), "test-mixed")
    last = corpus_pipeline.pack(spark, mixed, SF).collect()
    key = lambda rs: sorted((r.doc_id, r["size"], r.width) for r in rs)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(last) and len(last) == mixed.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda x: x if isinstance(x, str) else None if str(x) in ("nan", "<NA>", "None") else round(float(x), 4)
    key = lambda df: sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))
    assert key(got) == key(want)
