"""Kernels without Spark against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest

from braidwork.llm import license, lm, near, packing, pii, repeats, search, toxicity


def test_pii_base_spans_and_added_ones():
    text = "a.b@x.example.com, 1.2.3.4 and 300.1.1.1; 4111 1111 1111 1111. +1 (578) 555-6437 4918187128635271 call +49 30 1234567"
    found = [(k, text[s:e], base) for k, s, e, _, base in pii.find(text)]
    assert ("email", "a.b@x.example.com", True) in found and ("ip", "1.2.3.4", True) in found
    assert ("card", "4111 1111 1111 1111", True) in found and ("phone", "+49 30 1234567", True) in found
    assert ("phone", "+1 (578) 555-6437", False) in found  # within a match of too many digits
    assert not any(x[1].startswith("300") for x in found)
    assert pii.find(None) == [] and pii.redact("x@y.zz!") == "<email>!" and pii.redact(None) is None


def test_pii_iban_and_checksums():
    assert [x[0] for x in pii.find("iban DE89 3704 0044 0532 0130 00.")][-1] == "iban"
    assert not [x for x in pii.find("iban DE88 3704 0044 0532 0130 00.") if x[0] == "iban"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_email_equals_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("ab.@-_ é") for _ in range(rng.randint(0, 40)))
        assert list(pii._emails(t)) == [m.span() for m in pii.EMAIL.finditer(t)]


def test_toxicity_learns_subwords_of_unseen_forms():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdegimnorst") for _ in range(rng.randint(2, 7)))
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), "zlowei" + word())
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit_calibrated(texts[:480], np.array(labels[:480]))
    got = model.scores(texts[480:]) >= 0.3
    assert (got == np.array(labels[480:])).mean() > 0.95
    both = model.scores([None, "", "x" * 300_000, "zloweiabc"])
    assert np.isfinite(both).all() and both[0] == both[1]
    assert toxicity.fit(["a"], np.array([0])).scores(["b"])[0] < 0.01 and toxicity.fit([], np.zeros(0)).scores(["b"])[0] < 0.01


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 4)] * rng.randint(0, 1)
        most = rng.randint(0, 9)
        assert near.distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(_distance(a, b), most + 1)


def meet(a, b):
    """Whether two texts' sketches make them candidates."""
    rows = [np.frombuffer(near.marks(*near.sketch(w)), np.uint8)[None, :] for w in (a, b)]
    parts = [x for r in rows for x in (np.ascontiguousarray(r[:, : 4 * near.SKETCHES]).view(np.uint32), r[:, 4 * near.SKETCHES :])]
    return bool(near.alike(*parts)[0][0])


def test_order_minhash_meets_edited_texts_and_keeps_others_apart():
    rng = random.Random(3)
    met = apart = 0
    for _ in range(40):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        v = list(w)
        for _ in range(4):
            v[rng.randrange(200)] = "other"
        a, b = near.words(" ".join(w)), near.words(" ".join(v))
        met += meet(a, b) and near.similar(a, b)
        apart += not meet(a, near.words(" ".join(reversed(w))))
        half = near.words(" ".join([*w[100:], *w[:100]]))  # the same k-mers, but in another order
        apart += not meet(a, half) or len(set(near.sketch(a)[0]) & set(near.sketch(half)[0])) > near.SHARED
    assert met == 40 and apart == 80
    assert len(near.sketch(near.words(""))[0]) == 0 and len(near.sketch(near.words("one two"))[0]) == near.SKETCHES


def test_similar_texts_meet_at_the_stated_similarity():
    rng = random.Random(4)
    for share in (0.8, 0.85, 0.9):
        met = 0
        for _ in range(200):
            w = [f"w{rng.randint(0, 9999)}" for _ in range(250)]
            v = list(w)
            for at in rng.sample(range(250), round(250 * (1 - share))):
                v[at] = f"v{rng.randint(0, 9999)}"
            a, b = near.words(" ".join(w)), near.words(" ".join(v))
            met += meet(a, b) and near.similar(a, b)
        assert met >= 194, share


def test_short_similar_texts_always_share_a_run():
    rng = random.Random(6)
    seen = 0
    for _ in range(4000):
        w = [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(4, 30))]
        v = list(w)
        for _ in range(rng.randint(1, 7)):
            at = rng.randrange(len(v) + 1)
            v[at : at + rng.randint(0, 1)] = [f"v{rng.randint(0, 99)}"] * rng.randint(0, 1)
        a, b = near.words(" ".join(w)), near.words(" ".join(v))
        if len(b) and near.similar(a, b) and list(a) != list(b):
            seen += 1
            assert set(near.runs(a)) & set(near.runs(b)), (w, v)
    assert seen > 500
    for n in range(6, 16):  # one changed middle word
        w = [f"w{i}" for i in range(n)]
        v = [*w[: n // 2], "other", *w[n // 2 + 1 :]]
        assert set(near.runs(near.words(" ".join(w)))) & set(near.runs(near.words(" ".join(v))))


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    for runs in (1, 2, 3, 7):
        data = [sorted(bytes(rng.choice(b"ab") for _ in range(repeats.FULL)) for _ in range(rng.randint(0, 20))) for _ in range(runs)]
        coded = []
        for rows in data:
            if rows:
                m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, repeats.FULL)
                got, shared, _ = repeats.decode(repeats.encode(m, np.zeros(len(rows), repeats.META)))
                assert got == rows
                coded.append((got, shared))
        if not coded:
            continue
        order, shared = repeats.merge(coded)
        out = [coded[r][0][i] for r, i in order]
        assert out == sorted(x for rows in data for x in rows)
        for x, y, s in zip(out, out[1:], shared[1:], strict=False):
            assert x[:s] == y[:s] and (s == repeats.FULL or x[s] != y[s])


def test_length_buckets_are_the_best():
    rng = random.Random(6)
    from itertools import combinations

    for _ in range(30):
        widths = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randint(1, 9) for _ in widths]
        cost = lambda ends: sum(c * (min(e for e in ends if e >= w) - w) for w, c in zip(widths, counts, strict=True))
        best = min(cost([*c, widths[-1]]) for c in combinations(widths[:-1], 2))
        assert cost(packing.boundaries(widths, counts, 3)) == best
    assert packing.boundaries([], [], 3) == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.initial(np.ones(lm.VOCAB)).items()}
    x, y = rng.integers(0, lm.VOCAB, (2, 2, lm.WIDTH))
    ok = rng.random((2, lm.WIDTH)) < 0.8
    _, g = lm.gradients(p, x, y, ok)
    for k in "PQKVOABCac":
        i = tuple(rng.integers(0, s) for s in p[k].shape)
        kept = p[k][i]
        p[k][i] = kept + 1e-5
        up, _ = lm.gradients(p, x, y, ok)
        p[k][i] = kept - 1e-5
        down, _ = lm.gradients(p, x, y, ok)
        p[k][i] = kept
        assert math.isclose((up - down) / 2e-5, g[k][i], rel_tol=1e-3, abs_tol=1e-7)


def test_each_token_is_scored_once_in_its_window():
    rng = np.random.default_rng(1)
    p = lm.initial(np.ones(lm.VOCAB))
    ids, want = rng.integers(1, lm.VOCAB, 70), 0.0
    for i in range(70):
        a = 0 if i < lm.WIDTH else -(-(i - lm.WIDTH + 1) // lm.STRIDE) * lm.STRIDE
        x = [lm.END if j == 0 else ids[j - 1] for j in range(a, i + 1)]
        s, _ = lm._forward(p, np.array([x + [0] * (lm.WIDTH - len(x))]), 0)
        want += lm.log_probs(p, s[0, [len(x) - 1]], ids[[i]])[0]
    assert math.isclose(lm.score_ids(p, ids, np.array([70])).sum(), want, rel_tol=1e-4)
    # The classes and their members make one distribution.
    s = rng.normal(size=(1, lm.DIM)).astype(np.float32)
    every = lm.log_probs(p, np.repeat(s, lm.VOCAB, axis=0), np.arange(lm.VOCAB))
    assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)


@pytest.mark.parametrize("common", [0, 3, 256])
def test_pruned_search_is_exact(common, monkeypatch):
    monkeypatch.setattr(search, "COMMON", common)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    parts = [search._terms(t) for t in texts]
    terms = np.unique(np.concatenate([p[0] for p in parts]))
    idf = np.linspace(0.5, 3, len(terms))
    shard = search.Shard(terms, idf, 15.0)
    for i, t in enumerate(texts):
        shard.add(i, t)
    shard.seal()
    for q in range(0, 300, 7):
        if not len(parts[q][0]):
            continue
        at = np.searchsorted(terms, parts[q][0])
        scores = {}
        for i, (t, n, length) in enumerate(parts):
            w = dict(zip(t.tolist(), n.tolist(), strict=True))
            s = sum(c * idf[a] * w[x] * 2.2 / (w[x] + 1.2 * (0.25 + 0.75 * length / 15)) for x, c, a in zip(parts[q][0].tolist(), parts[q][1].tolist(), at, strict=True) if x in w)
            if s > 0:
                scores[i] = s
        want = sorted((round(s, 6) for s in scores.values()), reverse=True)[:5]
        got = shard.best([(at, parts[q][1], least) for least in (0.0, want[2], want[0] + 1)], 5)
        assert np.allclose([s for s, _ in got[0]], want, atol=1e-6)
        assert [s for s, _ in got[1]] == [s for s, _ in got[0] if s >= want[2]] and not got[2]


def test_licence_classifier_knows_families_and_the_unknown():
    features, w, b = license.fitted()
    index = {g: i for i, g in enumerate(features)}
    for text, want in (("Released under the MIT License.", "mit"), ("licensed under Apache License Version 2.0", "apache-2.0"), ("the town renewed the license of the bar", "unknown")):
        z = b + sum((w[index[g]] for g in license.grams(text) if g in index), np.zeros(len(b)))
        assert license.FAMILIES[int(z.argmax())] == want
    assert license.fitted()[1] is w


def test_byte_symbols_are_one_to_one():
    assert len(set(lm.byte_symbols())) == 256 and lm.byte_symbols()[32] == "Ġ"


def repeats_by_force(data):
    """The bytes of each text that stay, by all strings of LENGTH bytes in order."""
    seen, want = set(), []
    for t in data:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - repeats.LENGTH + 1):
            s = t[i : i + repeats.LENGTH]
            cover[i] += s in seen
            cover[i + repeats.LENGTH] -= s in seen
            seen.add(s)
        want.append(np.frombuffer(t, np.uint8)[np.cumsum(cover)[:-1] == 0].tobytes())
    return want


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh \n", "a", "é中xyz "])
def test_repeats_equal_brute_force(alphabet):
    rng = random.Random(9)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(60, 300))) for _ in range(4)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 3))) + rng.choice(alphabet) * rng.randint(0, 200) for _ in range(12)]
    data = [t.encode() for t in texts]
    want = repeats_by_force(data)
    rows, metas = [], []
    for t, _, place, first, last, owner, lo, hi, offset in repeats._anchored(data, None):
        m = np.zeros(len(place), repeats.META)
        m["doc"], m["place"], m["far"], m["near"] = owner, place - lo + offset, place - first, place - last
        rows.append(repeats._contexts(t, place, lo, hi))
        metas.append(m)
    if not rows:
        assert want == data
        return
    rows, metas = np.concatenate(rows), np.concatenate(metas)
    runs, late = [], []
    for k in range(3):  # three runs, as of three tasks
        r, m, more = repeats.collapsed(rows[k::3], metas[k::3])
        runs.append(zlib.compress(repeats.encode(r, m)))
        late.append(more)
    found = repeats.joined(np.concatenate([repeats.repeated(runs), *late]))
    for i, t in enumerate(texts):
        mine = found[found["doc"] == i]
        assert repeats.kept(t, np.stack([mine["start"], mine["stop"]], axis=1).tobytes())[1] == want[i]


def test_every_id_is_a_target_once():
    """Of texts shorter than a window, as long as one, and with later windows that end within or past the text."""
    from braidwork.llm import lm

    sizes = np.array([1, lm.WIDTH, lm.WIDTH + 1, lm.WIDTH + lm.LAST, 500])
    ids = np.arange(1, 1 + sizes.sum())
    heads, rest, _ = lm.training_rows(ids, np.cumsum(sizes))
    met = np.concatenate([heads[:, 1:].ravel(), rest[:, 1 + lm.WIDTH - lm.LAST :].ravel()])
    assert sorted(met[met >= 0].tolist()) == ids.tolist()


def test_base_without_a_model(spark, monkeypatch):
    from braidwork.llm import lm

    docs = spark.createDataFrame([(i, f"some words {i % 7} and rare{i}") for i in range(40)] + [(40, None)], "doc_id long, text string")
    want = sorted(map(tuple, lm.report(docs).drop("score").collect()))
    monkeypatch.setattr(lm, "train", None)
    assert sorted(map(tuple, lm.report(docs, scored_too=False).collect())) == want
