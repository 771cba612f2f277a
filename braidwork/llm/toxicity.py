"""Toxicity: embeddings of character n-grams averaged over a window of words into a linear softmax, trained in numpy.

Embeddings and softmax are trained jointly. A text's score is that of its worst window, so a few words in a long text
count; misspelt words share n-grams with known ones. Windows of a toxic text that hold nothing toxic must not teach:
training takes from each text only the window that the model so far finds worst (log-odds of n-grams at first).

Edge cases: a null or empty text has no n-grams and gets the score of the bias alone; ties between windows go to the
first; repeated rows get equal scores; conflicting labels of one document count as toxic; null labels are no labels;
without labels of both classes every score is the share of label 1 (0 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import fresh

BITS, SIZES, DIM, WINDOW = 16, (3, 4, 5), 8, 6
#: Bounds of the labelled sample that training reads on the driver.
MAX_ROWS, MAX_CHARS = 10_000, 30_000_000
#: Code points handled at once; bounds the memory of a task whatever the length of a text.
CHUNK = 2_000_000
#: Code points of short texts that are scanned together; their arrays fit a processor's cache.
GROUP = 200_000
CUT = 0.3


class _Tables:
    """Which of the first 65,536 code points are part of a word; built once per process."""

    word: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.word is None:
            cls.word = np.array([chr(i).isalnum() for i in range(65_536)])
        return cls.word


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for whatever is no part of a word, and a 0 at both ends."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[~_Tables.get()[np.minimum(a, 65_535)] & (a < 65_536)] = 0
    return a


def _grams(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket of the n-gram from each position, and whether it lies within one word (ends included)."""
    inside = a != 0
    h = a * np.uint32(0x9E3779B1)
    ok = np.ones(len(a), bool)
    for n in range(2, max(SIZES) + 1):
        size = len(a) - n + 1
        if size <= 0:
            return
        h = (h[:size] ^ (h[:size] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :]
        ok = ok[:size] & (inside[n - 2 : n - 2 + size] if n > 2 else True)
        if n in SIZES:
            yield ((h * np.uint32(0xC2B2AE35 + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32), ok


def _starts(a: np.ndarray) -> np.ndarray:
    """Where words start; an n-gram belongs to the word of its second position."""
    return np.flatnonzero((a[1:] != 0) & (a[:-1] == 0)) + 1


def _window_means(a: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean n-gram weight of each window of WINDOW words (fewer if there are fewer), and each word's start."""
    starts = _starts(a)
    if not len(starts):
        return np.zeros(0), starts
    total, count = np.zeros(len(a) + 1), np.zeros(len(a) + 1)
    for bucket, ok in _grams(a):
        total[1 : len(bucket) + 1] += np.where(ok, weight[bucket], 0)
        count[1 : len(bucket) + 1] += ok
    edges = np.append(starts, len(a))
    t, c = np.add.reduceat(total, starts), np.add.reduceat(count, starts)
    t, c = np.append(0, np.cumsum(t)), np.append(0, np.cumsum(c))
    w = min(WINDOW, len(starts))
    return (t[w:] - t[:-w]) / np.maximum(1, c[w:] - c[:-w]), edges


def _pieces(text: str) -> Iterator[str]:
    """The text in chunks that overlap by a window, cut at white space where there is any."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + CHUNK // 2, at + CHUNK)
        cut = cut if cut > 0 else at + CHUNK
        yield text[at:cut]
        back = cut
        for _ in range(WINDOW):
            back = text.rfind(" ", at + 1, back) if back > at else back
        at = back if at < back < cut and cut - back < CHUNK // 4 else cut
    yield text[at:]


def _bag(a: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The buckets of the n-grams of words that start in a[lo:hi]."""
    part = a[max(0, lo - 1) : hi + 1]
    return np.concatenate([b[ok] for b, ok in _grams(part)] or [np.zeros(0, np.int32)])


class Model:
    """weight: what each n-gram adds to the logit difference; scale and shift: the calibration of a text's worst window."""

    def __init__(self, weight: np.ndarray, bias: float, scale: float, shift: float):
        self.weight, self.bias, self.scale, self.shift = weight.astype(np.float32), bias, scale, shift

    def raw(self, text: str | None) -> float:
        best = -np.inf
        for piece in _pieces(text or ""):
            means, _ = _window_means(_codes(piece), self.weight)
            best = max(best, means.max(initial=-np.inf))
        return self.bias + (0.0 if best == -np.inf else float(best))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Short texts are joined and scanned together; long ones by themselves."""
        raw = np.full(len(texts), np.nan)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t and len(t) > GROUP:
                raw[i] = self.raw(t)
                continue
            group.append(i)
            size += len(t or "")
            if size > GROUP:
                raw[group] = self._together([texts[j] or "" for j in group])
                group, size = [], 0
        if group:
            raw[group] = self._together([texts[j] or "" for j in group])
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -60, 60)))

    def _together(self, texts: list[str]) -> np.ndarray:
        codes = [_codes(t) for t in texts]
        a = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        out = np.full(len(texts), self.bias)
        starts = _starts(a)
        if not len(starts):
            return out
        total, count = np.zeros(len(a)), np.zeros(len(a))
        for bucket, ok in _grams(a):
            total[1 : len(bucket) + 1] += np.where(ok, self.weight[bucket], np.float32(0))[: len(a) - 1]
            count[1 : len(bucket) + 1] += ok[: len(a) - 1]
        t, c = np.add.reduceat(total, starts), np.add.reduceat(count, starts)
        t, c = np.append(0, np.cumsum(t)), np.append(0, np.cumsum(c))
        owner = np.searchsorted(ends, starts, side="right")
        first = np.searchsorted(owner, np.arange(len(texts)), side="left")
        last = np.searchsorted(owner, np.arange(len(texts)), side="right")
        at = np.arange(len(starts))
        until = np.minimum(at + WINDOW, last[owner])
        # A window that would run over the text's end is scored only if it starts the text.
        whole = (at + WINDOW <= last[owner]) | (at == first[owner])
        means = np.where(whole, (t[until] - t[at]) / np.maximum(1, c[until] - c[at]), -np.inf)
        full = last > first
        out[full] = self.bias + np.maximum.reduceat(means, first[full])
        return out


def fit(texts: list[str], labels: np.ndarray, epochs: int = 5, seed: int = 7) -> Model:
    """Trains on the texts given; see the module's text for the method."""
    labels = np.asarray(labels, float)
    n, pos = len(labels), labels.sum()
    if not 0 < pos < n:
        p = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    df = np.ones((2, 1 << BITS))
    for t, y in zip(texts, labels, strict=True):
        df[int(y), np.unique(_bag(a := _codes(t), 1, len(a)))] += 1
    weight = np.log(df[1] / (pos + 2)) - np.log(df[0] / (n - pos + 2))
    weight[df.sum(axis=0) < 5] = 0
    embed = rng.normal(0, 0.05, (1 << BITS, DIM))
    soft, bias = rng.normal(0, 0.3, (2, DIM)), np.zeros(2)
    grad_e, grad_s, grad_b = np.full(1 << BITS, 1e-6), np.full((2, DIM), 1e-6), np.full(2, 1e-6)
    for epoch in range(epochs):
        bags = []
        for i, t in enumerate(texts):
            a = _codes(t)
            means, edges = _window_means(a, weight)
            if not len(means):
                continue
            w = min(WINDOW, len(edges) - 1)
            picks = [int(means.argmax())]
            if not labels[i] or epoch == 0:
                picks += [] if labels[i] else [int(rng.integers(len(means)))]
            bags += [(_bag(a, edges[k], edges[k + w] - 1), int(labels[i])) for k in picks]
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 128):
            batch = [bags[j] for j in order[at : at + 128] if len(bags[j][0])]
            if not batch:
                continue
            ids = np.concatenate([b for b, _ in batch])
            sizes = np.array([len(b) for b, _ in batch])
            y = np.array([c for _, c in batch])
            x = np.add.reduceat(embed[ids], np.append(0, np.cumsum(sizes)[:-1])) / sizes[:, None]
            z = x @ soft.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= np.where(y == 1, (len(labels) - pos) / pos, 1.0).clip(max=4)[:, None] / len(y)
            gs, gb, gx = p.T @ x, p.sum(axis=0), p @ soft
            rows = np.repeat(gx / sizes[:, None], sizes, axis=0)
            used, back = np.unique(ids, return_inverse=True)
            ge = np.zeros((len(used), DIM))
            np.add.at(ge, back, rows)
            grad_e[used] += (ge**2).mean(axis=1)
            grad_s += gs**2
            grad_b += gb**2
            embed[used] -= 0.5 * ge / np.sqrt(grad_e[used])[:, None]
            soft -= 0.1 * gs / np.sqrt(grad_s)
            bias -= 0.1 * gb / np.sqrt(grad_b)
        embed *= np.minimum(1, (df.sum(axis=0) - 2) / 6)[:, None] if epoch == epochs - 1 else 1
        weight = embed @ (soft[1] - soft[0])
    return Model(weight, float(bias[1] - bias[0]), 1.0, 0.0)


def fit_calibrated(texts: list[str], labels: np.ndarray, every: int = 5) -> Model:
    """Trains on the texts but each `every`th of either class; on those it calibrates, as the others are known to it."""
    labels = np.asarray(labels, int)
    held = np.zeros(len(labels), bool)
    for y in (0, 1):
        held[np.flatnonzero(labels == y)[::every]] = True
    model = fit([t for t, h in zip(texts, held, strict=True) if not h], labels[~held])
    if 0 < labels[~held].sum() < (~held).sum():
        raw = np.concatenate([model._together([texts[j] for j in part]) for part in np.array_split(np.flatnonzero(held), 1 + held.sum() // 100) if len(part)])
        model.scale, model.shift = _calibrate(raw, labels[held])
    return model


def _calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, with targets drawn in a little so that it stays finite."""
    pos = labels.sum()
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (len(labels) - pos + 2))
    s = raw.std() or 1.0
    x = np.stack([raw / s, np.ones_like(raw)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-4 * w), -4, 4)
    return float(w[0] / s), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fits on labelled documents whose crc32(doc_id) mod 4 is not 2, at most `max_rows` of them in the order of a hash
    and `max_chars` code points; of a longer text than a hundredth of that, nothing is read."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars // 100))
    # Both broadcasts hold max_rows rows at most, so no text is shuffled but the sample's.
    lengths = rows.select("doc_id", F.length("text").alias("n")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("toxic").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    chosen, size = [], 0
    for r in sorted(lengths.collect(), key=lambda r: (r.h, r.doc_id)):
        size += r.n
        if size > max_chars:
            break
        chosen.append((r.doc_id, int(r.toxic > 0)))
    if not chosen:
        return fit([], np.zeros(0))
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    found = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    found.sort(key=lambda r: r.doc_id)
    texts, ys = [r.text for r in found], [r.toxic for r in found]
    return fit_calibrated(texts, np.array(ys))


def score(docs: DataFrame, model: Model, name: str = "tox_score") -> DataFrame:
    """All columns of `docs`, and the score under `name`, which must be none of theirs."""
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            scores = model.scores(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, F.col("tox_score").alias("score"), (F.col("tox_score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with its columns."""
    name = fresh(docs, "tox_score")
    return score(docs, train(docs, labels), name).where(F.col(name) < CUT).drop(name)
