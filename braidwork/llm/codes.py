"""Vectors compressed to four bytes: product quantisation with codebooks from Lloyd's rounds over integers, by Hamerly's bounds.

A table in the shared folder holds for each vector its integer components and, for each of its parts, the entry it is assigned
to, one upper bound of its distance to that entry and one lower bound of the distance to any other. A round moves the bounds by
what the entries moved; only parts whose upper bound is not strictly below the lower one (or half the distance from their entry
to its nearest fellow) are held against all entries, in whole numbers, so a tie goes to the lower index as in a plain search.
Sums of a codebook's members are made per task and added up; only codebooks, whose size parameters bound, pass the driver.

Edge cases: rows with a null vector or with null or non-finite components are dropped; components times SCALE are held within
LIMIT, beyond which squared sums leave 64 bits; a part is a fourth of the longest vector's length, rounded up, and shorter
vectors count as filled with zeros; with fewer vectors than entries the codebook has as many entries as vectors; rows equal in
id are rows of their own, and start entries in the order of their components; null labels are one label; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import forget, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 26
#: Rows held against all entries at a time.
ROWS = 4096
#: Relative slack by which bounds are kept on their safe side of rounding.
SLACK = 2.0**-48


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: floors of SCALE times the components, of the rows that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(SCALE)) * x.cast("double")))).cast("int"))
    return embeddings.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows, parts and components of a list column whose lists have all PARTS * width items."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width)


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Both as doubles where all sums of squared differences are whole numbers that doubles hold, else as 64-bit integers."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    return np.float64 if 8 * x.shape[1] * float(most) ** 2 < 2.0**53 else np.int64


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry (the lower one of equals), its squared distance and the second least one."""
    kind = _exact(x, entries)
    index, least, second = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.full(len(x), np.inf)
    c = entries.astype(kind)
    norms = (c * c).sum(1)
    for at in range(0, len(x), ROWS):
        y = x[at : at + ROWS].astype(kind)
        d = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + norms
        rows, best = np.arange(len(y)), d.argmin(1)
        index[at : at + ROWS], least[at : at + ROWS] = best, d[rows, best].astype(np.int64)
        if len(entries) > 1:
            d[rows, best] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
            second[at : at + ROWS] = d.min(1)
    return index, least, second


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - entries) ** 2).sum(1)


def steps(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry moved, at least."""
    return np.sqrt(((old - new) ** 2).sum(-1).astype(float)) * (1 + SLACK)


def apart(entries: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to its nearest fellow, at most."""
    if len(entries) < 2:
        return np.full(len(entries), np.inf)
    d = np.array([np.delete(squared(entries, e), i).min() for i, e in enumerate(entries)], float)
    return np.sqrt(d) / 2 * (1 - SLACK)


def reassigned(x: np.ndarray, entries: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Index, upper and lower bound of each row after the entries moved, and how many rows were held against all entries."""
    order = np.argsort(moved)
    others = np.where(was == order[-1], moved[order[-2]] if len(moved) > 1 else 0.0, moved[order[-1]])
    upper, lower = (upper + moved[was]) * (1 + SLACK), (lower - others) - (np.abs(lower) + others) * SLACK
    lower[~np.isfinite(lower)] = np.inf
    bound = np.maximum(lower, half[was])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = np.sqrt(squared(x[open_], entries[was[open_]]).astype(float)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < bound[open_])]
    index = was.copy()
    if len(open_):
        index[open_], least, second = nearest(x[open_], entries)
        upper[open_], lower[open_] = np.sqrt(least.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
    return index, upper, lower, len(open_)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), PARTS).cast(pa.list_(kind))


def _assign(table: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """`table` with entries and bounds for `books` (parts, entries, components); `before`: the books that its bounds are for."""
    width = books.shape[2]
    moved = None if before is None else [steps(before[p], books[p]) for p in range(PARTS)]
    half = None if before is None else [apart(books[p]) for p in range(PARTS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), width)
            a, u, low = np.empty((len(x), PARTS), np.int32), np.empty((len(x), PARTS)), np.empty((len(x), PARTS))
            for p in range(PARTS):
                if moved is None:
                    a[:, p], least, second = nearest(x[:, p], books[p])
                    u[:, p], low[:, p] = np.sqrt(least.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
                else:
                    was, up, lo = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)[:, p] for c in ("entry", "upper", "lower"))
                    a[:, p], u[:, p], low[:, p], _ = reassigned(x[:, p], books[p], was.astype(np.int64), up, lo, moved[p], half[p])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), _lists(a, pa.int32()), _lists(u, pa.float64()), _lists(low, pa.float64())], names=["vec_id", "label", "v", "entry", "upper", "lower"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(rows, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, entry array<int>, upper array<double>, lower array<double>")


def _means(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry moved to the floored mean of its members; entries without any stay. A task gives one row per entry at most."""
    entries, width = books.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for b in batches:
            x, a = _matrix(b.column("v"), width), b.column("entry").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(a[:, p], minlength=entries)
                np.add.at(total[p], a[:, p], x[:, p].astype(np.int64))
        part, entry = np.nonzero(n)
        found = total[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists], names=["part", "entry", "n", "total"])

    each = table.select("v", "entry").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    new = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total")).collect():
        new[r.part, r.entry] = [t // r.n for t in r.total]
    return new


def trained(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The table of vectors with their final entries (vec_id, label, v, entry, upper, lower), and the codebooks."""
    whole = integers(embeddings)
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    fill: Column = F.slice(F.concat("v", F.array_repeat(F.lit(0), F.lit(PARTS * width))), 1, PARTS * width)
    filled = whole.withColumn("v", fill)
    start = filled.select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()
    books = np.array([r.v for r in start], np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2)
    table, before = filled, None
    if books.size:
        for at in range(rounds + 1):
            new = written(_assign(table, books, before), "codes")
            if at:
                forget(table)
            table = new
            if at < rounds:
                books, before = _means(table, books), books
    else:
        table = filled.select("*", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("entry", "int"), ("upper", "double"), ("lower", "double"))])
    return table, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, in decimal with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (the squared distance to what the code stands for), and the
    codebooks' digest."""
    table, books = trained(embeddings, entries, rounds)
    width = books.shape[2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, a = _matrix(b.column("v"), width), b.column("entry").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            error = sum((squared(x[:, p], books[p][a[:, p]]) for p in range(PARTS)), np.zeros(len(x), np.int64)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([bytes(r).hex() for r in a.astype(np.uint8)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(table.dtypes)
    coded = table.select("vec_id", "label", "v", "entry").mapInArrow(rows, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))


def report(embeddings: DataFrame) -> DataFrame:
    """Every kept row with its code, its error and the error of all rows of its label."""
    rows = written(compressed(embeddings), "codes-of")
    # Written before the join, so that a label with many rows is split, or its few sums sent to all, by their size.
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "codes-labels")
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
