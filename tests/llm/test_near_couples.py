"""Buckets of two members are held against each other at once, and words cut with few passes, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import near


def plain(text):
    """Hashes of words, a character after the other."""
    out, place, total = [], 0, None
    for c in text.lower():
        n = ord(c)
        if n > 65_535 or c.isalnum():
            power = pow(0x9E3779B97F4A7C15, place % near.POWERS + 1, 1 << 64) * (place // near.POWERS * 2 + 1)
            total, place = (total or 0) + (n + 1) * power, place + 1
        elif total is not None:
            out.append(total % (1 << 64))
            total, place = None, 0
    out += [] if total is None else [total % (1 << 64)]
    return near.mix(np.array(out, np.uint64))


def test_words():
    rng = np.random.default_rng(1)
    texts = ["", " -", "one", "x" * 64 + " " + "y" * 65, "-" * 99 + "z" * 200 + "-" * 99 + "a", "É\U00010400 \ud800b \U0001f600", "İ 中文!"]
    texts += ["".join(rng.choice(list("ab1 .-\nÄ"), 80)) for _ in range(50)]
    for t in texts:
        assert np.array_equal(near.words(t), plain(t)), t


def test_couples_are_those_of_buckets():
    rng = np.random.default_rng(2)
    n = 400
    base = [rng.integers(0, 1 << 62, 120).astype(np.uint64) for _ in range(n // 2)]
    texts = []
    for b in base:
        other = b.copy()
        other[rng.permutation(120)[: rng.integers(0, 50)]] = rng.integers(0, 1 << 62)
        texts += [b, other[: rng.integers(90, 121)]]
    size, gauges = np.array([len(t) for t in texts]), np.stack([near.gauge(t) for t in texts])
    root, at = rng.integers(0, 3, n), np.arange(0, n, 2)
    found = set(near.couples(root, size, gauges, at).tolist())
    for nearest in (True, False):
        for sides in (np.zeros(2, bool), np.array([True, False])):
            want = {i for i in at.tolist() if len(near.apart(root[i : i + 2], size[i : i + 2], gauges[i : i + 2], sides, nearest)[0])}
            assert found == want and 20 < len(found) < n // 2 - 20


def test_buckets_of_two_are_not_taken_one_by_one(spark, monkeypatch):
    """Links of small buckets come without a call for each of them."""

    def fails(*_):
        raise AssertionError("a bucket of two by itself")

    size = 60
    gauge = near.gauge(np.arange(size, dtype=np.uint64)).tobytes()
    roots = spark.createDataFrame([(i, i) for i in range(40)], "node long, root long")
    opened = spark.createDataFrame([(i // 2, i, size, 0) for i in range(40)], "bucket long, node long, size int, place int")
    monkeypatch.setattr(near, "apart", fails)
    got = near._unjoined(opened, roots, spark.createDataFrame([(i, bytearray(gauge)) for i in range(40)], "node long, gauge binary")).select("a", "b", F.lit(1))
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, i + 1) for i in range(0, 40, 2)]
