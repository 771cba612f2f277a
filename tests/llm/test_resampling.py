"""Resampling against a plain reading of its rules, for single words and for runs of several."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from braidwork.llm import queries, resampling

SCHEMA = "doc_id long, text string, rank long, bucket int, copies string"


def runs(text, orders):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]


def by_force(docs, target, orders, buckets, least, percent):
    """doc_id, n_features, weight, score, rank."""
    count = lambda texts: [zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, orders)[1]]
    s, t = count([d[1] for d in docs]), count(target)
    gain = {b: math.floor(1000 * math.log((t.count(b) + 1) * (len(s) + buckets) / ((s.count(b) + 1) * (len(t) + buckets)))) for b in set(s)}
    out = []
    for i, text in docs:
        n, fs = runs(text, orders)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able):
        r[4] = k + 1 if k < percent * len(able) // 100 else None
    for r in out:
        if r not in able:
            r[4] = None
    return sorted(map(str, out))


@pytest.mark.parametrize(("orders", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (1, 7, 1, 50), (2, 10_000, 5, 30), (3, 50, 2, 100)])
def test_by_force(spark, orders, buckets, least, percent):
    rng = random.Random(orders * 31 + buckets)
    word = lambda: rng.choice(["Alpha", "beta", "Ünder", "naïve", "x1", "日本", "don't", "e-mail", "\x7f", "_", "42"])
    docs = [(i, rng.choice([" ", "\n", ", "]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, docs[3][1]), (None, docs[3][1]), docs[4], docs[4], docs[4], (5, "other text of the same id"), (102, "beta " * 9000)]
    target = ["beta x1 naïve " * 5, None, "", "Beta, beta"]
    table = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], SCHEMA).repartition(3)
    got = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), orders, buckets, least=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == by_force(docs, target, orders, buckets, least, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs, none).count() == 0
    some = spark.createDataFrame([(1, "a b c", None, None, None), (2, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in resampling.resampled(some, none).collect()}
    assert got[1].n_features == 3 and got[1].rank is None and got[2].weight == 0 and got[2].n_features == 0


def test_copies_of_one_row_take_neighbouring_ranks(spark):
    docs = spark.range(5000).selectExpr("cast(null as long) doc_id", "repeat('word ', 25) text").unionByName(spark.range(50).selectExpr("id doc_id", "repeat('other ', 30) text"))
    got = resampling.resampled(docs, spark.createDataFrame([("other",)], "text string")).where("rank is not null").collect()
    assert sorted(r.rank for r in got) == list(range(1, 506))


def test_the_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE["op13_resampling"]).fetchall()
    got = queries.op13_resampling(spark, sf)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
