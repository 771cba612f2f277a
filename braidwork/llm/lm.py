"""LM scoring: a causal self-attention model on subword ids, trained in numpy, over overlapping context windows.

Texts are lower-cased (A-Z) and cut into words; the ids of ` word` in a public byte-level BPE are its subwords, and one
end follows. Of the ids the model keeps the 256 bytes and the most frequent others, VOCAB in all; rarer ones are spelt in
bytes. The model is one head of attention and one hidden layer with residuals, over embeddings of an id and of the one
before it; its output is a softmax over classes, then one within the class. A window holds WIDTH inputs and begins STRIDE
after the one before; each token is scored once, in the window that shows it WIDTH - STRIDE or more before it, or all there
is.

A text's score is that of a Bayesian mixture: with the chances of PRIOR one share of attention model and base holds for
the whole text, and each of its tokens has the mixture by that share of what both give it (the base: its count's share). The
share 0 is the base itself, so no text's score is more than -log10 of its chance, 0.22 digits, below its base's, however small
the table that the model learnt from.

Texts are cut into ids once, and both training and scores read the table of them. What is learnt from: counts of all words of all training documents (the vocabulary and the base score), the counts of its
ids in them (the biases of the output), and the windows of all training texts. First the driver takes steps on START windows
or a few more; then the windows are dealt into groups of about GROUP, whatever the cluster, each of which takes steps on its
own, and the parameters are averaged in a tree. A text's first window has all its ids as targets, each later one the LAST at
its end, which follow on each other: every id is a target. So what is gathered grows with the corpus.

Edge cases: a null text is empty: one end; repeated rows are scored each on its own; ties in counts are broken by the
id; null ids count as held out never (they train); other columns are not read; an empty table gives an empty result;
without training documents all counts are 0 and the model is uniform.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

#: The tokenizer's file; a parameter of all that needs it.
TOKENIZER = os.environ.get("BRAIDWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
CLASSES, EACH = 32, 32
VOCAB = CLASSES * EACH
DIM, HIDDEN, WIDTH, STRIDE = 24, 64, 24, 16
END = 0
#: Words whose counts and ids are sent to every task, others that a task keeps, and words cut at a time.
SENT, KEPT, SLICE = 1 << 16, 1 << 17, 40_000
#: Bytes of texts whose words a task counts at a time.
COUNTED = 1 << 23
#: Beside the first id of each token, where ids are written.
MARK = 1 << 14
#: Words that the tokenizer gets as one text.
CHUNK = 256
#: Windows of the driver's start, how often it sees them, windows of a group; targets of a later window; targets in a step; the rate, which falls to a
#: tenth in a group.
START, EPOCHS, GROUP, LAST, STEP = 20_000, 3, 400_000, STRIDE, 1536
RATE = 1.2e-2
#: Windows that a group's training takes at a time, of as many texts as have them.
TAKEN = 8192
#: Shares of the attention model in the mixtures of it and the base that a text is scored by, and their weights before it.
SHARES, PRIOR = (0.0, 0.2, 0.5, 0.8, 0.95), (0.6, 0.1, 0.1, 0.1, 0.1)


#: Ids and places of words take a fifth less room than by the session's codec.
written = partial(common.written, codec="zstd")


def training() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents."""

    def run(batches):
        for b in batches:
            texts = b.column(0)
            # Stretches of texts of some COUNTED bytes; the words of one are counted before they leave the task.
            stretch = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // COUNTED
            cuts = np.flatnonzero(np.diff(stretch, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo))).flatten()
                found = pc.value_counts(words.filter(pc.not_equal(words, "")))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    found = docs.where(training()).select("text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def byte_symbols() -> list[str]:
    """The characters by which byte-level BPE writes the bytes 0 to 255: printable ones stand for themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


def encoder(tokenizer: str):
    """Words to ids of the tokenizer laid end to end, and how many each has. CHUNK words are encoded as one text: an id that
    begins with a space begins a word. Where that does not tell as many words, each is encoded by itself."""
    # A task has one core, and each thread of the tokenizer would keep memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    t.encode_special_tokens = True
    named, space = t.get_vocab(), byte_symbols()[32]
    begins = np.zeros(max(named.values()) + 1, bool)
    begins[[i for s, i in named.items() if s.startswith(space)]] = True

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" " + w.decode("utf-8", "replace") for w in words]
        parts = [texts[lo : lo + CHUNK] for lo in range(0, len(texts), CHUNK)]
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, found in zip(parts, ids(["".join(x) for x in parts]), strict=True):
            first = np.flatnonzero(begins[found])
            if len(first) == len(part) and first[0] == 0:
                flat.append(found)
                sizes.append(np.diff(np.append(first, len(found))))
            else:
                each = ids(part)
                flat += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    return t, encode


def piece_counts(counts: DataFrame, tokenizer: str) -> dict[int, int]:
    """How often each id of the tokenizer occurs in all words of (word, n); as many rows as it has ids at most."""

    def run(batches):
        _, encode = encoder(tokenizer)
        total = np.zeros(1 << 17)
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo in range(0, len(words), 10_000):
                found, sizes = encode(words[lo : lo + 10_000])
                total += np.bincount(found, np.repeat(n[lo : lo + 10_000], sizes), len(total))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have].astype(np.int64), pa.int64())], ["id", "n"])

    sums = counts.select(F.col("word").cast("binary").alias("word"), "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in sums.collect()}


def vocabulary(tokenizer: str, count: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each id of the tokenizer the model's ids that stand for it, laid end to end, and where they begin; from how often
    the tokenizer's ids occur."""
    t, _ = encoder(tokenizer)
    symbols = byte_symbols()
    single = {t.token_to_id(c): b for b, c in enumerate(symbols)}
    value = {c: b for b, c in enumerate(symbols)}
    more = sorted((i for i in count if i not in single), key=lambda i: (-count[i], i))[: VOCAB - 257]
    place = {i: 1 + k for k, i in enumerate([*single, *more])}
    of_byte = {b: place[i] for i, b in single.items()}
    named = sorted((i, s) for s, i in t.get_vocab().items())
    pieces: list[tuple[int, ...]] = [()] * (named[-1][0] + 1)
    tally = np.zeros(VOCAB)
    for i, text in named:
        pieces[i] = (place[i],) if i in place else tuple(of_byte[value[c]] for c in text if c in value)
        for x in pieces[i]:
            tally[x] += count.get(i, 0)
    # Ids in the order of their counts, so that classes hold ids alike in frequency; the end is 0.
    new = np.zeros(VOCAB, np.int16)
    new[1 + np.argsort(-tally[1:], kind="stable")] = np.arange(1, VOCAB)
    flat = np.array([x for xs in pieces for x in xs], np.int64)
    return new[flat], np.append(0, np.cumsum([len(xs) for xs in pieces]))


class Speller:
    """Words to the model's ids, laid end to end, and how many each has."""

    def __init__(self, tokenizer: str, pieces: tuple[np.ndarray, np.ndarray]):
        _, self.encode = encoder(tokenizer)
        self.flat, self.begin = pieces

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.encode(words)
        n = self.begin[ids + 1] - self.begin[ids]
        where = np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = np.repeat(np.arange(len(words)), sizes)
        return self.flat[where], np.bincount(word, n, len(words)).astype(np.int64)


def initial(tally: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights; the output's biases are the logarithms of the counts."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (VOCAB, DIM), "G": (VOCAB, DIM), "P": (WIDTH, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "A": (DIM, HIDDEN), "B": (HIDDEN, DIM), "C": (CLASSES, DIM), "U": (CLASSES, EACH, DIM)}
    p = {k: (rng.normal(0, 0.1 if k in "EGPCU" else s[0] ** -0.5, s)).astype(np.float32) for k, s in shapes.items()}
    share = (tally + 0.5).reshape(CLASSES, EACH)
    p["a"] = np.zeros(HIDDEN, np.float32)
    p["c"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    p["u"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which is short: a product is much faster there."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(a.shape[:-1])


def _totals(a: np.ndarray) -> np.ndarray:
    """Sums of columns."""
    return np.ones(len(a), a.dtype) @ a


@lru_cache
def _mask(first: int) -> np.ndarray:
    return np.where(np.arange(WIDTH)[None, :] <= np.arange(first, WIDTH)[:, None], np.float32(0), np.float32(-1e9))


def _flat(a: np.ndarray) -> np.ndarray:
    """One large product instead of many small ones."""
    return a.reshape(-1, a.shape[-1])


def _joined(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Q and K as one, with the scale of the scores, and V and O: what stands between two inputs, and after their mean. So
    neither keys nor values are made of each input."""
    return (p["Q"] * p["Q"].dtype.type(DIM**-0.5)) @ p["K"].T, p["V"] @ p["O"]


def _outputs(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The output's weights, with the biases as a last column: states end with a 1 there."""
    return np.concatenate([p["C"], p["c"][:, None]], axis=1), np.concatenate([p["U"], p["u"][..., None]], axis=2)


def _ended(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the flat states, each with a 1 after it."""
    out = np.ones((len(at), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states.take(at, axis=0)
    return out


def _forward(p: dict, x: np.ndarray, first: int) -> tuple:
    """States after the inputs x (rows of WIDTH ids), at the places from `first` on."""
    n = WIDTH - first
    between, after = _joined(p)
    e = p["E"].take(x, axis=0)
    e += p["P"]
    e[:, 1:] += p["G"].take(x[:, :-1], axis=0)
    own = np.ascontiguousarray(e[:, first:])
    q = (_flat(own) @ between).reshape(own.shape)
    w = q @ e.transpose(0, 2, 1)
    w += _mask(first)
    # Scores are small; no maximum is taken off before the exponential but a bound kept.
    np.exp(np.minimum(w, 60, out=w), out=w)
    w /= _sums(w)[..., None]
    m = w @ e
    y = (_flat(m) @ after).reshape(m.shape)
    y += own
    h = _flat(y) @ p["A"]
    h += p["a"]
    h = np.maximum(h, 0, out=h)
    out = (h @ p["B"]).reshape(y.shape)
    out += y
    return out, (e, own, q, w, m, y, h.reshape(-1, n, HIDDEN))


def log_probs(p: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the targets after flat states."""
    group = (targets // EACH).astype(np.int8)
    order = np.argsort(group, kind="stable")
    group, member, flat = group[order], targets[order] % EACH, _ended(states, order)
    heads, members = _outputs(p)
    at = np.arange(len(order))
    z = flat @ heads.T
    found = z[at, group]
    found -= _log_sum(z)
    edges = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    for g in range(CLASSES):
        if edges[g] < edges[g + 1]:
            np.matmul(flat[edges[g] : edges[g + 1]], members[g].T, out=z[edges[g] : edges[g + 1]])
    found += z[at, member]
    found -= _log_sum(z)
    out = np.empty_like(found)
    out[order] = found
    return out


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of the rows of `z`, which is overwritten. One number is taken off all rows; where
    that would leave nothing of a row, each row's greatest."""
    top = z.max(initial=0)
    if top > 60:
        top = z.max(axis=1, keepdims=True)
        z -= top
        top = top[:, 0]
    elif len(z) and (lost := z[:, 0] < -60).any():
        top = np.where(lost, z.max(axis=1), 0).astype(z.dtype)
        z -= top[:, None]
    else:
        top = z.dtype.type(0)
    np.exp(z, out=z)
    return np.log(_sums(z)) + top


def windows(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end in `ids`, each with its end: the inputs of all windows, the places of their targets, and
    each window's text. A text's first window is its own; places outside the text are -1."""
    begins = np.append(0, ends[:-1])
    n = ends - begins
    many = 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE))
    text = np.repeat(np.arange(len(n)), many)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    at = begins[text][:, None] + start[:, None] + np.arange(WIDTH)[None, :]
    place = np.where(at < ends[text][:, None], at, -1)
    before = np.where(at > begins[text][:, None], at - 1, -1)
    x = np.where((before >= 0) & (before < ends[text][:, None]), ids[np.clip(before, 0, len(ids) - 1)], END)
    return x, place, text


def score_ids(p: dict, ids: np.ndarray, ends: np.ndarray, batch: int = 128) -> np.ndarray:
    """The natural log-probability of each id, its text's ids before it given."""
    x, place, text = windows(ids, ends)
    total = np.zeros(len(ids))
    head = np.append(True, text[1:] != text[:-1])
    for sel, first in ((np.flatnonzero(head), 0), (np.flatnonzero(~head), WIDTH - STRIDE)):
        for lo in range(0, len(sel), batch):
            part = sel[lo : lo + batch]
            states, _ = _forward(p, x[part], first)
            at = place[part][:, first:]
            ok = at >= 0
            total[at[ok]] = log_probs(p, states[ok], ids[at[ok]])
    return total


def mixtures(model: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each token (a row) and each of SHARES the base-10 logarithm of the mixture of the model's and the base's
    probability, from their logarithms."""
    top, above, ten = np.maximum(model, base), model >= base, math.log(10)
    low = np.exp(np.abs(model - base) * -ten)
    out = np.empty((len(model), len(SHARES)))
    for i, share in enumerate(SHARES):
        upper = np.where(above, share, 1 - share)
        upper += (1 - upper) * low
        out[:, i] = top + np.log(np.maximum(upper, 1e-300)) / ten
    return out


def _loss(z: np.ndarray, target: np.ndarray, n: int = 1) -> tuple[float, np.ndarray]:
    """Summed loss of a softmax over the rows of `z`, which is overwritten, and a nth of its gradient."""
    at = np.arange(len(target))
    if len(z) and (z.max() > 60 or z.min() < -60):
        z -= z.max(axis=1, keepdims=True)
    out = z[at, target].sum()
    np.exp(z, out=z)
    total = _sums(z)
    z *= (1 / (total * total.dtype.type(n)))[:, None]
    z[at, target] -= z.dtype.type(1 / n)
    return float(np.log(total).sum() - out), z


def _added(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by row: rows are taken EACH at a time, of which a product with ones and zeros adds all."""
    block = (at // EACH).astype(np.int16)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(rows // EACH + 1)).tolist()
    values = values.take(order, axis=0)
    hot = np.eye(EACH, dtype=values.dtype).take(at[order] % EACH, axis=0)
    out = np.zeros((rows // EACH, EACH, values.shape[1]), values.dtype)
    for b in range(len(out)):
        if edges[b] < edges[b + 1]:
            np.matmul(hot[edges[b] : edges[b + 1]].T, values[edges[b] : edges[b + 1]], out=out[b])
    return out.reshape(rows, -1)


def gradients(p: dict, x: np.ndarray, y: np.ndarray, ok: np.ndarray, first: int = 0) -> tuple[float, dict]:
    """Mean loss of the targets y where ok, which stand at the places from `first` on, and its gradients."""
    s, (every, input_, q, w, m, r, h) = _forward(p, x, first)
    between, after = _joined(p)
    two = _flat
    g: dict[str, np.ndarray] = {}
    t = y[ok]
    group = (t // EACH).astype(np.int8)
    order = np.argsort(group, kind="stable")
    place = np.flatnonzero(ok)[order]
    t, group, flat = t[order], group[order], _ended(two(s), place)
    heads, members = _outputs(p)
    n = max(1, len(t))
    loss, d = _loss(flat @ heads.T, group, n)
    own = d.T @ flat
    g["C"], g["c"] = own[:, :DIM], own[:, DIM]
    df = d @ p["C"]
    edges = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    parts = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
    z, inner = np.empty((len(t), EACH), flat.dtype), np.empty_like(df)
    for c, at in parts:
        np.matmul(flat[at], members[c].T, out=z[at])
    more, d = _loss(z, t % EACH, n)
    own = np.zeros_like(members)
    for c, at in parts:
        np.matmul(d[at].T, flat[at], out=own[c])
        np.matmul(d[at], p["U"][c], out=inner[at])
    g["U"], g["u"] = own[..., :DIM], own[..., DIM]
    df += inner
    ds = np.zeros_like(s)
    two(ds)[place] = df
    g["B"] = two(h).T @ two(ds)
    dh = two(ds) @ p["B"].T
    dh *= two(h) > 0
    g["A"], g["a"] = two(r).T @ dh, _totals(dh)
    dr = dh @ p["A"].T
    dr += two(ds)
    own = two(m).T @ dr
    g["V"], g["O"] = own @ p["O"].T, p["V"].T @ own
    dm = (dr @ after.T).reshape(s.shape)
    dw = dm @ every.transpose(0, 2, 1)
    dw -= _sums(dm * m)[..., None]
    dw *= w
    dq = dw @ every
    own = two(input_).T @ two(dq)
    scale = own.dtype.type(DIM**-0.5)
    g["Q"], g["K"] = own @ p["K"] * scale, own.T @ p["Q"] * scale
    # An input is asked, is met by those that ask, and is part of their means.
    de = dw.transpose(0, 2, 1) @ q
    de += w.transpose(0, 2, 1) @ dm
    dr += two(dq) @ between.T
    de[:, first:] += dr.reshape(s.shape)
    g["P"] = _totals(de.reshape(len(de), -1)).reshape(WIDTH, DIM)
    # An id stands for itself at its place and for the one before at the next.
    both = np.zeros((*x.shape, 2 * DIM), de.dtype)
    both[..., :DIM], both[:, :-1, DIM:] = de, de[:, 1:]
    both = _added(VOCAB, x.ravel(), two(both))
    g["E"], g["G"] = both[:, :DIM], both[:, DIM:]
    return (loss + more) / n, g


class Trainer:
    """Adam over training windows: rows of WIDTH + 1 ids, of which the first is the input before the others; -1 is nothing."""

    def __init__(self, p: dict, seed: int):
        # All parameters lie in one array, of which `p` has views.
        self.all, self.p, at = np.concatenate([v.ravel() for v in p.values()]), {}, 0
        for k, v in p.items():
            self.p[k], at = self.all[at : at + v.size].reshape(v.shape), at + v.size
        self.m, self.v = np.zeros_like(self.all), np.zeros_like(self.all)
        self.n, self.rng = 0, np.random.default_rng(seed)

    def run(self, rows: np.ndarray, first: int, rate: float) -> None:
        """A step for each STEP targets, which stand at the places from `first` on."""
        order, size = self.rng.permutation(len(rows)), STEP // (WIDTH - first)
        for lo in range(0, len(order), size):
            part = rows.take(order[lo : lo + size], axis=0).astype(np.int64)
            y = part[:, 1 + first :]
            ok = y >= 0
            if not ok.any():
                continue
            _, g = gradients(self.p, np.maximum(part[:, :-1], 0), y, ok, first)
            self.n += 1
            lr = rate * min(1.0, self.n / 20)
            d = np.concatenate([g[k].ravel() for k in self.p])
            # m and v are 10 and 100 times Adam's, which its last factor makes up for.
            self.m *= np.float32(0.9)
            self.m += d
            d *= d
            self.v *= np.float32(0.99)
            self.v += d
            np.sqrt(self.v, out=d)
            size_ = math.sqrt(0.01 / (1 - 0.99**self.n))
            d += np.float32(1e-8 / size_)
            np.divide(self.m, d, out=d)
            d *= np.float32(0.1 * lr / (1 - 0.9**self.n) / size_)
            self.all -= d


def pack(p: dict) -> bytes:
    return b"".join(np.asarray(p[k], np.float32).tobytes() for k in sorted(p))


def unpack(blob: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(blob, np.float32, n, at * 4).reshape(like[k].shape).copy()
        at += n
    return out


class Places(dict):
    """Words to numbers, the next one for a word not met before."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Cut:
    """Texts to words and ids, with the words that are sent to every task at hand, and others as they come."""

    def __init__(self, sent: dict):
        self.sent, self.known = sent, len(sent["words"])
        self.speller = Speller(sent["tokenizer"], sent["pieces"])
        self.clear()

    def clear(self) -> None:
        self.place = Places((w, i) for i, w in enumerate(self.sent["words"]))
        self.other: list[bytes] = []
        self.flat, self.lengths = [self.sent["flat"]], [self.sent["lengths"]]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
        """(first, words of each) of stretches of the texts with some SLICE words; only a stretch's texts are made Python's."""
        held: list[list[bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            held.append((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
            size += len(held[-1])
            if size > SLICE or i == len(texts) - 1:
                yield i + 1 - len(held), held
                held, size = [], 0

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Ids of all texts with their ends laid end to end; where texts end; and for each text the places of its words: in
        the words sent, or from `known` on in `other`. How many ids each word and end has is left in `sizes`."""
        if len(self.other) > KEPT:
            self.clear()
        met = len(self.place)
        found = np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64)
        if new := list(islice(self.place, met, None)):
            flat, n = self.speller.spell(new)
            self.other += new
            self.flat, self.lengths = [np.concatenate([*self.flat, flat])], [np.concatenate([*self.lengths, n])]
        many = np.array([len(ws) for ws in texts], np.int64)
        flat, lengths = np.append(self.flat[0], np.int16(END)), np.append(self.lengths[0], 1)
        begin = np.cumsum(lengths) - lengths
        each = np.cumsum(many)
        w = np.insert(found, each, len(lengths) - 1)
        n = lengths[w]
        where = np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = [found[i:j] for i, j in zip((each - many).tolist(), each.tolist(), strict=True)]
        each = each + np.arange(1, len(each) + 1)
        self.sizes = n
        return flat[where].astype(np.int64), np.cumsum(n)[each - 1], at


def prepared(counts: DataFrame, tokenizer: str) -> dict:
    """What every task needs: the tokenizer, the pieces, and words, at most SENT, with counts and ids. Their number is
    bounded by a least count, which the table of how many words have which count gives."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    pieces = vocabulary(text, piece_counts(counts, text))
    have = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(SENT).collect()
    total, least = 0, None
    for r in have:
        total += r.words
        if total > SENT:
            break
        least = r.n
    # If not even the words with the highest count fit, none is sent; all words are spelt and counted where they are met.
    top = counts.where(F.col("n") >= least).select(F.col("word").cast("binary").alias("w"), "n").collect() if least else []
    words = sorted(((bytes(r.w), r.n) for r in top), key=lambda x: (-x[1], x[0]))
    flat, lengths = Speller(text, pieces).spell([w for w, _ in words])
    return {"tokenizer": text, "pieces": pieces, "words": [w for w, _ in words], "counts": np.array([n for _, n in words], np.int64), "lengths": lengths, "flat": flat}


def training_rows(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows for a Trainer, of which each id is a target once: the texts' first windows, and those whose last LAST ids go on from
    there; and how many of the latter each text has."""
    begins = np.append(0, ends[:-1])
    n = ends - begins
    cut = lambda text, start: _rows(ids, begins[text], ends[text], begins[text] + start)
    many = np.maximum(0, -(-(n - WIDTH) // LAST))
    text = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return cut(np.arange(len(n)), 0), cut(text, LAST + step * LAST), many


def _rows(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(-1, WIDTH)[None, :]
    rows = np.where(at < hi[:, None], ids[np.clip(at, 0, len(ids) - 1)], -1)
    return np.where(at < lo[:, None], END, rows).astype(np.int16)


def cut_texts(docs: DataFrame, shared) -> DataFrame:
    """For each text its ids, the first of each token marked; the places of its tokens' counts, that of words that were not sent
    and of the end after them; the names of the former; and what training asks for: a key by what the text teaches, so that nothing
    depends on how texts were dealt to tasks, and the number of windows (0: held out). How often each id is taught stands in the
    first row of some."""

    def run(batches):
        import xxhash

        cut = Cut(shared.value)
        known = cut.known
        for b in batches:
            for lo, texts in cut.slices(b.column(1)):
                part = b.slice(lo, len(texts))
                ids, ends, at = cut.ids(texts)
                first = np.cumsum(cut.sizes) - cut.sizes
                begins, tokens = np.append(0, ends[:-1]), np.array([len(a) + 1 for a in at])
                teaches = part.column(2).to_numpy(zero_copy_only=False)
                n = np.where(teaches, 1 + np.maximum(0, -(-(ends - begins - WIDTH) // LAST)), 0)
                tally = [np.bincount(ids[np.repeat(teaches, ends - begins)], minlength=VOCAB).tolist()] + [None] * (len(at) - 1)
                marked = ids.astype(np.int16)
                marked[first] |= MARK
                written_ids = [marked[i:j].tobytes() for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                rare = [a[a >= known] for a in at]
                met = np.unique(np.concatenate(rare))
                names = np.array([xxhash.xxh64_intdigest(cut.other[i], seed=42) for i in (met - known).tolist()], np.uint64).view(np.int64)
                places = [np.append(np.minimum(a, known), known + 1).astype(np.uint16 if known + 2 <= 1 << 16 else np.uint32).tobytes() for a in at]
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rare])).astype(np.int32)), pa.array(names[np.searchsorted(met, np.concatenate(rare))]))
                keys = pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in written_ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tally, pa.list_(pa.int64())), pa.array(written_ids, pa.binary()), pa.array(places, pa.binary()), rest], ["doc_id", "key", "n", "tokens", "tally", "ids", "places", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", training().alias("teaches"))
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, tokens long, tally array<long>, ids binary, places binary, rest array<long>")


def train(table: DataFrame) -> dict:
    """The parameters, from a table as of cut_texts(); see the module's text."""
    sums = table.select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # VOCAB rows
    tally = np.zeros(VOCAB)
    for r in sums:
        tally[r.pos] = r.n
    p = initial(tally)
    count, pieces = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    if not count:
        return p
    # As many texts, in the order of their keys, as have START windows or so; of a long text no more than that.
    most = F.lit(START * WIDTH * 2)
    taught = table.where("n > 0")
    some = taught.select("key", F.substring("ids", F.lit(1), most).alias("ids")).orderBy("key").limit(max(1, START * pieces // count)).collect()

    def read(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' first windows and the later ones."""
        ends = np.cumsum([len(x) // 2 for x in blobs])
        return training_rows(np.frombuffer(b"".join(blobs), np.int16) & ~np.int16(MARK), ends)[:2]

    start = Trainer(p, 1)
    rows = np.concatenate([x for r in some for x in read([bytes(r.ids)])])[: 2 * START]
    for e in range(EPOCHS):
        start.run(rows, 0, RATE * (1 - 0.8 * e / EPOCHS))
    p = start.p
    groups = parts = -(-count // GROUP)
    now = table.sparkSession.sparkContext.broadcast(pack(p))

    def local(batches):
        trainer, n, part = Trainer(unpack(now.value, p), 2), 0, None
        found = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))

        def learn(held: list[bytes]) -> int:
            one, more = read(held)
            rate = RATE * max(0.1, 1 - 0.9 * n * parts / count)
            trainer.run(one, 0, rate)
            trainer.run(more, WIDTH - LAST, rate)
            return len(one) + len(more)

        held, size = [], 0
        for group, windows_, ids in found:
            held.append(ids.as_py())
            size, part = size + windows_, group
            if size >= TAKEN:
                n, held, size = n + learn(held), [], 0
        if held:
            n += learn(held)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([pack(trainer.p)], pa.binary())], ["part", "n", "p"])

    def mean(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist(), float)
        total = sum(w * np.frombuffer(b.as_py(), np.float32).astype(float) for w, b in zip(n, table.column("p"), strict=True))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // 32], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "p": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    dealt = taught.select(F.pmod(F.col("key"), F.lit(groups)).cast("int").alias("group"), "n", "ids", "key")
    means = dealt.repartitionById(groups, "group").sortWithinPartitions("key").select("group", "n", "ids").mapInArrow(local, "part int, n long, p binary")
    while groups > 1:
        means, groups = means.groupBy(F.floor(F.col("part") / 32)).applyInArrow(mean, "part int, n long, p binary"), -(-groups // 32)
    trained = means.first()
    return unpack(trained.p, p) if trained else p


def report(docs: DataFrame, tokenizer: str = TOKENIZER, scored_too: bool = True) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score; see the module's text. Without `scored_too`
    no model is trained and there is no score; the other columns come the same way."""
    spark = docs.sparkSession
    counts = written(word_counts(docs), "lm-counts")
    texts = docs.where(training()).count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = words + texts, kinds + (texts > 0)
    sent = prepared(counts, tokenizer)
    shared = spark.sparkContext.broadcast(sent)
    table = cut_texts(docs, shared)
    # Texts are cut once for training and scores.
    table = written(table, "lm-windows") if scored_too else table
    params = spark.sparkContext.broadcast(pack(train(table))) if scored_too else None
    like = {k: np.empty(v.shape, np.float32) for k, v in initial(np.zeros(VOCAB)).items()}
    under = total + 0.5 * (distinct + 1)

    ended = float(math.log10((texts + 0.5) / under))

    known = len(sent["words"])
    value = np.concatenate([np.log10((sent["counts"] + 0.5) / under), [0.0, ended]])

    def run(batches):
        p = unpack(params.value, like) if params else None
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            stretch = np.cumsum(whole.column(1).to_numpy()) // SLICE
            cuts = np.flatnonzero(np.diff(stretch, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                b = whole.slice(lo, hi - lo)
                n, rest = b.column(1).to_numpy(), b.column(4)
                blobs = [x.as_py() for x in b.column(2)]
                ids, ends = np.frombuffer(b"".join(blobs), np.int16), np.cumsum([len(x) // 2 for x in blobs])
                words = np.frombuffer(b"".join(x.as_py() for x in b.column(3)), np.uint16 if known + 2 <= 1 << 16 else np.uint32)
                starts = np.flatnonzero(ids & MARK)
                ids = (ids & ~np.int16(MARK)).astype(np.int64)
                model = np.add.reduceat(score_ids(p, ids, ends), starts) / math.log(10) if p else np.zeros(len(starts))
                given, rare = value[words], words == known
                text = np.repeat(np.arange(len(n)), n)
                sums = np.zeros((len(n), len(SHARES)))
                if p:
                    both = mixtures(model, given)
                    both[rare] = 0.0
                    sums = np.stack([np.bincount(text, both[:, k], len(n)) for k in range(len(SHARES))], 1)
                base = np.bincount(text, given, len(n))
                edge = np.append(0, np.cumsum(np.bincount(text[rare], minlength=len(n)))).astype(np.int32)
                scores = pa.ListArray.from_arrays(pa.array(edge), pa.array(model[rare].astype(np.float32)))
                k = n - 1 - np.diff(edge)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(key, key + len(n)), pa.int64()), pa.array(n), pa.array(k.astype(np.int64)), pa.array(base), rest, scores, pa.array(list(sums), pa.list_(pa.float64()))], ["doc_id", "key", "n", "k", "base", "rest", "model", "sums"])
                key += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = table.select("doc_id", "tokens", "ids", "places", "rest").mapInArrow(run, f"doc_id {kind}, key long, n long, k long, base double, rest array<long>, model array<float>, sums array<double>")
    scored = written(scored, "lm-scores")
    rare = counts.select(F.xxhash64(F.col("word")).alias("name"), "n").withColumnRenamed("n", "c")
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(under)))
    met = scored.select("key", F.inline(F.arrays_zip(F.col("rest").alias("name"), F.col("model").alias("model")))).join(rare, "name", "left")
    met = met.select("key", "c", F.col("model").cast("double").alias("model"), value.alias("base"))
    # As mixtures(), for the words whose counts had to be looked up.
    low, top = F.least("model", "base"), F.greatest("model", "base")
    upper = lambda share: F.when(F.col("model") >= F.col("base"), share).otherwise(1 - share)
    mixed = lambda share: top + F.log10(F.greatest(upper(share) + (1 - upper(share)) * F.pow(F.lit(10.0), low - top), F.lit(1e-300)))
    # The share 0 is the base, whose sum is there already.
    more = met.groupBy("key").agg(F.sum("base").alias("more"), F.count("c").alias("known"), *[F.sum(mixed(share)).alias(f"more{i}") for i, share in enumerate(SHARES) if share])
    all_ = scored.drop("rest", "model").join(more, "key", "left")
    chances = [F.get("sums", F.lit(i)) + F.coalesce(f"more{i}" if SHARES[i] else "more", F.lit(0.0)) + math.log10(chance) for i, chance in enumerate(PRIOR)]
    best = F.greatest(*chances)
    total_chance = F.lit(0.0)
    for c in chances:
        total_chance = total_chance + F.pow(F.lit(10.0), c - best)
    return all_.select(
        "doc_id",
        (~training()).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("k") + F.coalesce("known", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        *[(best + F.log10(total_chance)).alias("score")] * scored_too,
    )
