"""Packing: length buckets with the least padding, and batches of a fixed budget of words inside each.

The histogram has the exact lengths of all documents, no more entries than the longest has words. Over it dynamic programming
chooses the BUCKETS boundaries for which padding every document to its bucket's boundary adds least. Inside a bucket the
documents, in the order of a hash, are cut into batches of as many as the budget of padded words holds, at least one.

Edge cases: null and empty texts have length 0 and are packed like others (width 1); repeated rows each get a place;
ties in the hash's order are broken by id; a text longer than the budget is a batch by itself; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import partitions, running, words_in, written

BUCKETS, BUDGET = 16, 65_536
SEED = 5


def boundaries(widths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The ascending boundaries, the last the largest width, that minimise the sum of count x (boundary - width).

    cost[k][j]: the least total width of the first j cells in k buckets. The best last cut moves right with j, so a
    divide-and-conquer over j needs some n log n steps for each bucket.
    """
    order = np.argsort(widths)
    w, c = np.array(widths, np.int64)[order], np.array(counts, np.int64)[order]
    n = len(w)
    if n <= buckets:
        return w.tolist()
    total = np.append(0, np.cumsum(c))
    cost = np.append(0, w * total[1:]).astype(float)
    cuts = []
    for _ in range(1, buckets):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0
        work = [(1, n, 0, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            at = np.arange(first, min(last, mid - 1) + 1)
            tries = cost[at] + w[mid - 1] * (total[mid] - total[at])
            best = int(tries.argmin())
            new[mid], cut[mid] = tries[best], at[best]
            work += [(lo, mid - 1, first, cut[mid]), (mid + 1, hi, cut[mid], last)]
        cost = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(w[j - 1]))
        j = cut[j]
    if j:
        ends.append(int(w[j - 1]))
    return sorted(set(ends))


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, size (words), bucket (from 0), width (padded words), batch (within the bucket, from 0), slot (in the batch)."""
    rows = docs.select("doc_id", words_in(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix"))
    rows = written(rows, "pack-sizes")
    found = rows.groupBy(F.greatest("size", F.lit(1)).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
    ends = boundaries([r.w for r in found], [r.n for r in found], buckets) or [1]
    count = sum(r.n for r in found)
    table = F.array(*[F.lit(e).cast("long") for e in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(table, lambda e: e < F.col("size"))))
    rows = rows.withColumn("width", F.get(table, F.col("bucket")))
    placed = running(rows, ["bucket", "width"], ["mix", "doc_id"], None, "place", max(partitions(docs.sparkSession), count // 50_000))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width")))
    return placed.select("doc_id", "size", "bucket", "width", F.floor(F.col("place") / each).alias("batch"), (F.col("place") % each).alias("slot"))


def batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per batch: bucket, batch, width, documents, words, padded (documents x width)."""
    rows = packed(docs, buckets, budget)
    return rows.groupBy("bucket", "batch", "width").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("words"), (F.count(F.lit(1)) * F.max("width")).alias("padded"))
