"""Attention by two joined matrices is that by queries, keys, values and outputs, with fewer multiplications."""

import numpy as np

from braidwork.llm import lm


class Counted(np.ndarray):
    """An array that counts the multiplications of products it takes part in."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **more):
        plain = [np.asarray(x) for x in inputs]
        if out:
            more["out"] = tuple(np.asarray(x) for x in out)
        found = getattr(ufunc, method)(*plain, **more)
        if ufunc is np.matmul:
            Counted.done += np.asarray(found).size * plain[0].shape[-1]
        return np.asarray(found).view(Counted) if isinstance(found, np.ndarray) else found


def drawn(kind):
    rng = np.random.default_rng(3)
    p = {k: (v + rng.normal(0, 0.05, v.shape)).astype(kind) for k, v in lm.initial(np.arange(lm.VOCAB, 0, -1.0)).items()}
    return p, rng.integers(0, lm.VOCAB, (32, lm.WIDTH))


def test_states_are_those_of_queries_keys_and_values():
    p, x = drawn(float)
    e = p["E"][x] + p["P"]
    e[:, 1:] += p["G"][x[:, :-1]]
    w = (e @ p["Q"]) @ (e @ p["K"]).transpose(0, 2, 1) / np.sqrt(lm.DIM)
    w = np.exp(np.where(np.tril(np.ones((lm.WIDTH, lm.WIDTH), bool)), w, -np.inf))
    y = (w / w.sum(axis=2, keepdims=True)) @ (e @ p["V"]) @ p["O"] + e
    want = np.maximum(y @ p["A"] + p["a"], 0) @ p["B"] + y
    for first in (0, lm.WIDTH - lm.LAST):
        assert np.allclose(lm._forward(p, x, first)[0], want[:, first:], atol=1e-9)


def test_no_keys_and_values_of_each_input():
    p, x = drawn(np.float32)
    first = lm.WIDTH - lm.LAST
    targets = x[:, first:].size
    Counted.done = 0
    lm._forward({k: v.view(Counted) for k, v in p.items()}, x, first)
    # A target's own: two products with joined matrices, one with each input and one of their mean, the hidden layer.
    own = 2 * lm.DIM**2 + 2 * lm.WIDTH * lm.DIM + 2 * lm.DIM * lm.HIDDEN
    assert own <= Counted.done / targets < own * 1.1


def test_gradients_of_later_windows():
    """Of the joined matrices' parts, by differences, in windows whose targets stand at the end."""
    p, x = drawn(float)
    rng, first = np.random.default_rng(4), lm.WIDTH - lm.LAST
    x, y = x[:5], rng.integers(0, lm.VOCAB, (5, lm.LAST))
    ok = rng.random(y.shape) < 0.8
    _, g = lm.gradients(p, x, y, ok, first)
    for name in "QKVOPEG":
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (1e-5, -1e-5):
            q = {**p, name: p[name].copy()}
            q[name][at] += step
            losses.append(lm.gradients(q, x, y, ok, first)[0])
        assert np.isclose((losses[0] - losses[1]) / 2e-5, g[name][at], rtol=1e-4, atol=1e-9), name
