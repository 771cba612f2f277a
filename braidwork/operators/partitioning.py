"""Tasks of some size, and balanced partitions by cost: sequential kernels, each over the items of one batch, whose number the batch size fixes."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a task sorts.
SORTED = 1 << 18


class _Greatest(tuple):
    """A tuple that a heap of least elements gives greatest first."""

    def __lt__(self, other: tuple) -> bool:
        return tuple.__gt__(self, other)


def differencing(costs: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """The largest-differencing method for `parts` ways. A partial partition is `parts` subsets (sum, size, items in the order
    in which they came), greatest first; the two whose sums spread most (of equals those with the greater first subset) are
    joined, greatest to least, until one is left. It begins with one of each item or, for parts of an equal number of items,
    of each `parts` neighbours in the order of cost. Parts come as they stand in the last one, with ascending indices."""
    ranked = sorted((c, i) for i, c in enumerate(costs))
    if equal and len(costs) % parts:
        raise ValueError(f"{len(costs)} items cannot be dealt into {parts} parts of one size")
    width, empty = parts if equal else 1, (0, 0, ())
    heap: list = []

    def push(subsets: list[tuple]) -> None:
        subsets.sort(reverse=True)
        heapq.heappush(heap, (subsets[-1][0] - subsets[0][0], _Greatest(subsets[0]), subsets))

    for at in range(0, len(ranked), width):
        push([(c, 1, ((i, c),)) for c, i in ranked[at : at + width]] + [empty] * (parts - width))
    while len(heap) > 1:
        (*_, one), (*_, two) = heapq.heappop(heap), heapq.heappop(heap)
        push([(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in zip(one, reversed(two), strict=True)])
    return [sorted(i for i, _ in items) for *_, items in heap[0][2]] if heap else [[] for _ in range(parts)]


def least_loaded(costs: list[int], parts: int) -> list[list[int]]:
    """Each item, in its order, to the part with the least sum."""
    sums, out = [(0, k) for k in range(parts)], [[] for _ in range(parts)]
    for i, c in enumerate(costs):
        s, k = heapq.heappop(sums)
        out[k].append(i)
        heapq.heappush(sums, (s + c, k))
    return out


def first_fit(costs: list[int], cap: int) -> list[list[int]]:
    """Each item into the first bin with room; one over the cap has a bin of its own. The greatest room under each node of a tree
    over the bins leads to the first that fits, so an item takes as many steps as the tree is deep."""
    width = 1 << max(0, len(costs) - 1).bit_length()
    room, bins = [cap] * (2 * width), []
    for i, c in enumerate(costs):
        at = 1
        if c > cap:  # a new bin, the first that nothing is in
            at = width + len(bins)
        else:
            while at < width:
                at = 2 * at if room[2 * at] >= c else 2 * at + 1
        if at - width == len(bins):
            bins.append([])
        bins[at - width].append(i)
        room[at] -= c
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def chunks(costs: list[int], size: int) -> list[list[int]]:
    """Consecutive items; one that brings the sum to `size` or more closes its chunk."""
    out, total = [[]], 0
    for i, c in enumerate(costs):
        out[-1].append(i)
        total += c
        if total >= size:
            out.append([])
            total = 0
    return out if out[-1] else out[:-1]


def stretches(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Rows sorted by keys as batches of whole groups, each with the groups' bounds; a batch and the group that goes on are
    in memory at a time, however many groups a task has."""
    kept = None
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        t = b if kept is None else kept if b is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
        if t is None:
            return
        key = list(zip(*(t.column(k).to_pylist() for k in keys), strict=True))
        at = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1])]
        if b is None:
            yield t, list(zip(at, [*at[1:], len(key)], strict=True))
        else:
            if at[-1]:
                yield t.slice(0, at[-1]), list(zip(at[:-1], at[1:], strict=True))
            kept = t.slice(at[-1])


def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` dealt by their keys to as many tasks as have some SORTED rows each, and as a shuffle has at least: what the windows of
    a task sort does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // SORTED)), *keys)


def assign(rows: DataFrame, keys: list[str], order: list[str], cost: str, kernel: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """keys, order columns, cost and part: the kernel over each batch's costs in order."""

    def run(batches):
        for t, edges in stretches(batches, keys):
            part, costs = [-1] * t.num_rows, [int(c) for c in t.column(cost).to_pylist()]
            for lo, hi in edges:
                for k, items in enumerate(kernel(costs[lo:hi])):
                    for i in items:
                        part[lo + i] = k
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(part, pa.int32())], [*t.schema.names, "part"])

    kinds = dict(rows.dtypes)
    cols = [*keys, *order, cost]
    dealt = rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in cols), "part int"]))
