"""Bootstrap intervals whose replicates are spread over tasks and equal, digit by digit, those of one generator run in a row.

The generator is PCG64 and draws below n come from its 32-bit numbers by Lemire's method, which now and then refuses one. PCG64
can jump ahead, so the only thing a task has to know is how many numbers were refused before its own; a first job over the
generator's numbers counts those by chunk, each kind of draw over the chunks its calls may reach. Any slice of replicates can
then be drawn by itself. A suite's scores reach its slices, of which there is a fixed number, as packed doubles in the order of
the questions: what is moved grows with the questions, as does what a task holds, 16 bytes for each of its suite's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.evaluation import REPLICATES, SEED
from braidwork.sources.shared import written

#: Numbers that are counted as one; numbers that are looked at and draws that are made at a time, as many as a cache holds; tasks
#: that look; slices of a suite's replicates.
CHUNK, DRAWN, LOOKERS, SLICES = 1 << 20, 1 << 17, 1024, 32


def raw(seed: int, first: int, n: int) -> np.ndarray:
    """The generator's 32-bit numbers from `first` on, n of them: the low half of each 64-bit one, then its high half."""
    bits = np.random.PCG64(seed)
    bits.advance(first // 2)
    return bits.random_raw((first % 2 + n + 1) // 2).astype("<u8").view("<u4")[first % 2 :][:n]


def refused(x: np.ndarray, n: int) -> np.ndarray:
    # Of a product only the lower half is asked for, which 32 bits hold.
    return x * np.uint32(n) < np.uint32((2**32 - n) % n)


def _taken(seed: int, first: int, n: int, count: int) -> tuple[np.ndarray, int]:
    """`count` draws below n from the numbers from `first` on, and the number after the last one taken."""
    if n == 1:  # takes no number
        return np.zeros(count, np.int64), first
    parts, have, least = [], 0, (2**32 - n) % n
    while have < count:
        x = raw(seed, first, count - have).astype(np.uint64)
        x *= np.uint64(n)
        kept = x.astype(np.uint32) >= np.uint32(least) if least else None
        first += len(x)
        x >>= np.uint64(32)
        parts.append((x if kept is None or kept.all() else x[kept]).view(np.int64))
        have += len(parts[-1])
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64), first


def drawn(seed: int, first: int, n: int, count: int) -> np.ndarray:
    """`count` draws below n from the numbers from `first` on."""
    return _taken(seed, first, n, count)[0]


@dataclass
class Draws:
    """Calls of one generator in a row: (n, count) each; refused: for each n how many numbers each chunk of `size` refuses, from
    a first chunk on; starts: each call's first number."""

    calls: list[tuple[int, int]]
    seed: int
    size: int
    refused: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)

    def after(self, first: int, n: int, count: int) -> int:
        """The number after `count` draws below n from `first` on."""
        if n == 1 or not count:
            return first
        if not (2**32 - n) % n:
            return first + count
        begin, refusals = self.refused[n]
        chunk = first // self.size
        if chunk < begin:
            raise LookupError("draws before the chunks that were looked at")
        taken = np.cumsum(self.size - refusals[chunk - begin :])
        wanted = count + int(np.searchsorted(self._kept(n, chunk), first % self.size))
        k = int(np.searchsorted(taken, wanted))
        if k == len(taken):
            raise LookupError("draws after the chunks that were looked at")
        return (chunk + k) * self.size + int(self._kept(n, chunk + k)[wanted - (int(taken[k - 1]) if k else 0) - 1]) + 1

    def _kept(self, n: int, chunk: int) -> np.ndarray:
        """The places in a chunk of the numbers that are not refused."""
        begin, refusals = self.refused[n]
        if chunk - begin < len(refusals) and not refusals[chunk - begin]:
            return np.arange(self.size)
        return np.flatnonzero(~refused(raw(self.seed, chunk * self.size, self.size), n))

    def at(self, call: int, draw: int) -> int:
        return self.after(self.starts[call], self.calls[call][0], draw)


def _reach(calls: list[tuple[int, int]], slack: float) -> dict[int, tuple[int, int]]:
    """For each n that refuses numbers the first and last number that its calls may come to: as many are refused as is likely,
    give or take `slack` standard deviations."""
    mean = spread = 0.0
    out: dict[int, tuple[int, int]] = {}
    for n, count in calls:
        share = (2**32 - n) % n / 2**32
        lo = max(0, int(mean - slack * spread**0.5) - 1024)
        if n > 1:
            mean, spread = mean + count / (1 - share), spread + count * share / (1 - share) ** 2
            if share:
                hi, have = int(mean + slack * spread**0.5) + 1024, out.get(n, (lo, 0))
                out[n] = (min(lo, have[0]), max(hi, have[1]))
    return out


def draws(spark: SparkSession, calls: list[tuple[int, int]], seed: int) -> Draws:
    """Where each call's draws begin. The numbers are looked at by Spark in chunks; what is gathered is one count for each chunk
    and n whose calls may reach it."""
    size, slack = CHUNK, 10.0
    while True:
        found = Draws(calls, seed, size)
        reach = {n: (lo // size, hi // size + 1) for n, (lo, hi) in _reach(calls, slack).items()}

        def look(parts: Iterator[pd.DataFrame], reach=reach) -> Iterator[pd.DataFrame]:
            for part in parts:
                for chunk in part.id.tolist():
                    kinds = [n for n, (lo, hi) in reach.items() if lo <= chunk < hi]
                    if kinds:
                        total = np.zeros(len(kinds), np.int64)
                        for lo in range(0, size, DRAWN):
                            x = raw(seed, chunk * size + lo, min(DRAWN, size - lo))
                            total += [np.count_nonzero(refused(x, n)) for n in kinds]
                        yield pd.DataFrame({"n": kinds, "chunk": chunk, "refused": total})

        if reach:
            chunks = max(hi for _, hi in reach.values())
            rows = spark.range(0, chunks, numPartitions=min(chunks, LOOKERS)).mapInPandas(look, "n long, chunk long, refused long").toPandas()
            for n, part in rows.sort_values("chunk").groupby("n"):
                found.refused[int(n)] = (reach[int(n)][0], part.refused.to_numpy(np.int64))
        try:
            end = 0
            for n, count in calls:
                found.starts.append(end)
                end = found.after(end, n, count)
            return found
        except LookupError:  # once in more runs than there will be
            slack *= 4


def _packed(pairs: DataFrame, keys: list[str], suites: list[str]) -> DataFrame:
    """keys, suite, chunk, a and b: the scores of some questions each, as doubles laid end to end; chunks are numbered in the order
    of the ids."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            names = list(zip(*(b.column(k).to_pylist() for k in by), strict=True))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo < hi:
                    scores = [pa.array([b.column(c)[lo:hi].to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in ("sa", "sb")]
                    yield pa.RecordBatch.from_arrays([*(b.column(k)[lo : lo + 1] for k in by), pa.array([chunk], pa.int64()), *scores], [*by, "chunk", "a", "b"])
                    chunk += 1

    by, kinds = [*keys, "suite"], dict(pairs.dtypes)
    order = [*by, F.col("id").asc_nulls_last()]
    rows = pairs.where(F.col("suite").isin(*suites)).select(*by, "id", F.col("sa").cast("double").alias("sa"), F.col("sb").cast("double").alias("sb"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("id")
    return dealt.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), "chunk long, a binary, b binary"]))


def _resampled(pairs: DataFrame, keys: list[str], suites: list[str], replicates: int, seed: int, plans: dict[tuple, tuple[Draws, int]], sized: DataFrame) -> DataFrame:
    """keys, replicate, delta. plans: by the sizes of the suites (and, for chained contrasts, their keys) the generator's calls
    and the number of the contrast's first one; sized: keys with those, as `plan`."""
    spark = pairs.sparkSession
    rows, step = [], -(-replicates // SLICES)
    for number, (found, call) in enumerate(plans.values()):
        for i, suite in enumerate(suites):
            n = found.calls[call + i][0]
            rows += [(number, suite, i, first, min(step, replicates - first), found.at(call + i, first * n)) for first in range(0, replicates, step)]
    slices = spark.createDataFrame(rows, "plan int, suite string, suite_at int, first int, count int, start long")
    packed = written(_packed(pairs, keys, suites), "pairs")
    dealt = packed.join(sized, keys).join(F.broadcast(slices), ["plan", "suite"])  # a row for each slice, as plans have

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        r = pdf.iloc[0]
        va, vb = (np.frombuffer(b"".join(pdf[c]), float) for c in ("a", "b"))
        n, place, deltas = len(va), int(r.start), []
        many = max(1, DRAWN // n)
        for lo in range(0, int(r["count"]), many):
            now = min(many, int(r["count"]) - lo)
            at, place = _taken(seed, place, n, now * n)
            at = at.reshape(now, n)
            deltas.append(100 * (va[at].mean(axis=1) - vb[at].mean(axis=1)) / len(suites))
        out = pd.DataFrame({"suite_at": r.suite_at, "replicate": np.arange(r["first"], r["first"] + r["count"], dtype=np.int64), "delta": np.concatenate(deltas)})
        return out.assign(**{k: r[k] for k in keys})[[*keys, "suite_at", "replicate", "delta"]]

    kinds = dict(pairs.dtypes)
    names = ", ".join(f"{k} {kinds[k]}" for k in keys)
    # Few bytes make much work, so the slices are dealt to as many tasks, which are not put together by their size.
    dealt = dealt.repartition(len(rows), *keys, "suite", "first")
    parts = dealt.groupBy(*keys, "suite", "first").applyInPandas(run, f"{names}, suite_at int, replicate long, delta double")
    # Suites are added in their order, as sums of doubles depend on it.
    listed = F.sort_array(F.collect_list(F.struct("suite_at", "delta")))
    return parts.groupBy(*keys, "replicate").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["delta"]).alias("delta"))


def _sizes(pairs: DataFrame, keys: list[str], suites: list[str]) -> DataFrame:
    per = pairs.groupBy(*keys).agg(*[F.count_if(F.col("suite") == s).alias(f"_{i}") for i, s in enumerate(suites)])
    return per.select(*keys, F.array(*[F.col(f"_{i}") for i in range(len(suites))]).alias("sizes"))


def replicates_of(pairs: DataFrame, keys: list[str], suites: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """keys, replicate, delta: questions resampled with the same indices for both models, suite by suite in the given order from
    a generator that each contrast begins anew. What the driver plans by is the sizes of suites, of which contrasts over the
    same questions have the same."""
    sized = _sizes(pairs, keys, suites)
    kinds = [tuple(r[0]) for r in sized.select("sizes").distinct().collect()]
    if any(0 in k for k in kinds):
        raise ValueError("a contrast lacks a suite")
    plans = {k: (draws(pairs.sparkSession, [(n, n * replicates) for n in k], seed), 0) for k in kinds}
    numbers = pairs.sparkSession.createDataFrame([(list(k), i) for i, k in enumerate(plans)], "sizes array<long>, plan int")
    return _resampled(pairs, keys, suites, replicates, seed, plans, sized.join(F.broadcast(numbers), "sizes").drop("sizes"))


def _interval(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, lo, hi: the 95 % interval of a group's replicates, whose number is a parameter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.percentile(pdf[value], [2.5, 97.5])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "lo": lo, "hi": hi}])

    kinds = dict(values.dtypes)
    return values.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "lo double, hi double"]))


def bootstrap(pairs: DataFrame, keys: list[str], suites: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """keys, delta, lo, hi: the mean over suites of the mean differences, in points, and the interval of its replicates."""
    per = pairs.groupBy(*keys, "suite").agg((F.avg("sa") - F.avg("sb")).alias("d")).groupBy(*keys).agg((100 * F.avg("d")).alias("delta"))
    return per.join(_interval(replicates_of(pairs, keys, suites, replicates, seed), keys, "delta"), keys)


def seed_read(pairs: DataFrame, key: str, order: list, suites: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """key, delta, lo, hi for each seed of a method (in `order`), and with a null key the mean over seeds and its interval in two
    levels: as often as there are seeds a seed is drawn, and one of its replicates. One generator serves all, in that order."""
    spark = pairs.sparkSession
    sizes = {r[key]: tuple(r.sizes) for r in _sizes(pairs.where(F.col(key).isin(*order)), [key], suites).collect()}
    if set(sizes) != set(order) or any(0 in s for s in sizes.values()):
        raise ValueError("a seed lacks a suite")
    calls = [(n, n * replicates) for k in order for n in sizes[k]] + [(n, replicates) for _ in order for n in (len(order), replicates)]
    found = draws(spark, calls, seed)
    plans = {(k,): (found, i * len(suites)) for i, k in enumerate(order)}
    kind = dict(pairs.dtypes)[key]
    numbers = spark.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} {kind}, plan int")
    of = written(_resampled(pairs, [key], suites, replicates, seed, plans, numbers), "replicates").join(F.broadcast(numbers), key)  # read twice below

    step = max(1, DRAWN // 8)
    rows = []
    for i in range(len(order)):
        call = len(order) * len(suites) + 2 * i
        rows += [(i, first, min(step, replicates - first), found.at(call, first), found.at(call + 1, first)) for first in range(0, replicates, step)]

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                yield pd.DataFrame({"turn": r.turn, "at": np.arange(r.first, r.first + r.n), "plan": drawn(seed, r.one, len(order), r.n), "replicate": drawn(seed, r.two, replicates, r.n)})

    picks = spark.createDataFrame(rows, "turn int, first int, n int, one long, two long").mapInPandas(pick, "turn int, at long, plan int, replicate long")
    listed = F.sort_array(F.collect_list(F.struct("turn", "delta")))
    mixed = picks.join(of, ["plan", "replicate"]).groupBy("at").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["delta"] / len(order)).alias("delta"))
    points = pairs.where(F.col(key).isin(*order)).groupBy(key, "suite").agg((F.avg("sa") - F.avg("sb")).alias("d")).groupBy(key).agg((100 * F.avg("d")).alias("delta"))
    each = points.join(_interval(of.drop("plan"), [key], "delta"), key)
    both = points.agg(F.avg("delta").alias("delta")).withColumn("_one", F.lit(1)).join(_interval(mixed.withColumn("_one", F.lit(1)), ["_one"], "delta"), "_one")
    return each.unionByName(both.select(F.lit(None).cast(kind).alias(key), "delta", "lo", "hi"))
