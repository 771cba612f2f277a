"""Codes against plain Lloyd rounds in whole numbers; bounds against full searches."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from braidwork.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def by_force(rows, entries, rounds):
    """vec_id, code, error of kept rows and the codebooks, by full searches in Python integers."""
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([1, *(-(-len(v) // 4) for _, v, _ in kept)])
    kept = sorted((i is not None, i or 0, v + [0] * (4 * width - len(v)), lab) for i, v, lab in kept)
    parts = [[v[p * width : (p + 1) * width] for _, _, v, _ in kept] for p in range(4)]
    books = [list(map(list, parts[p][:entries])) for p in range(4)]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    find = lambda p: [min(range(len(books[p])), key=lambda e: (d(x, books[p][e]), e)) for x in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            of = find(p)
            for e in range(len(books[p])):
                if own := [x for x, a in zip(parts[p], of, strict=True) if a == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    of = [find(p) for p in range(4)]
    out = [("".join(f"{of[p][i]:02x}" for p in range(4)), sum(d(parts[p][i], books[p][of[p][i]]) for p in range(4))) for i in range(len(kept))]
    return sorted((k[1] if k[0] else -1, *o) for k, o in zip(kept, out, strict=True)), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "dim", "entries"), [(150, 8, 16), (60, 6, 256), (40, 4, 3), (3, 1, 2)])
def test_codes_by_force(spark, n, dim, entries):
    rng = random.Random(n)
    rows = [(i * 3 % n if i else None, [rng.choice([rng.uniform(-1, 1), 0.5, 0.0]) for _ in range(dim)], i % 3 or None) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, None), (n + 4, [float("inf"), *[0.0] * (dim - 1)], 2), (n + 5, rows[1][1], 2), (n + 6, rows[1][1], 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = codes.compressed(table, entries).collect()
    want, digest = by_force(rows, entries, codes.ROUNDS)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_agree_with_full_searches_and_spare_some():
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (12, 4))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-25, 25, (3000, 4))).astype(np.int64)
    entries = x[:32].copy()
    entries[5] = entries[4]
    index, least, second = codes.nearest(x, entries)
    upper, lower, searched = np.sqrt(least.astype(float)), np.sqrt(second), []
    for _ in range(6):
        new = entries.copy()
        for e in np.unique(index):
            new[e] = x[index == e].sum(0) // (index == e).sum()
        index, upper, lower, n = codes.reassigned(x, new, index, upper, lower, codes.steps(entries, new), codes.apart(new))
        entries = new
        want, least, _ = codes.nearest(x, entries)
        assert (index == want).all() and (upper >= np.sqrt(least.astype(float))).all()
        searched.append(n)
    assert searched[-1] < 1500 < 3000


def test_large_components_are_exact():
    x = np.array([[codes.LIMIT, -codes.LIMIT], [codes.LIMIT, codes.LIMIT - 1]], np.int64)
    entries = np.array([[codes.LIMIT, codes.LIMIT], [codes.LIMIT, codes.LIMIT - 2]], np.int64)
    index, least, second = codes.nearest(x, entries)
    assert index.tolist() == [1, 0] and least.tolist() == [(2 * codes.LIMIT - 2) ** 2, 1] and second[1] == 1


def test_empty_tables_and_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.report(empty).count() == 0
    rows = [(1, [0.1, 0.2, 0.3, 0.4], None, "x", 1), (1, [0.5, 0.2, 0.3, 0.4], None, "x", 1), (2, [], 4, "x", 1), (3, None, 4, "x", 1)]
    got = codes.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}


def test_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op12_codes"]).fetchall()
    assert sorted(map(tuple, queries.op12_codes(spark, sf).collect())) == sorted(want)
