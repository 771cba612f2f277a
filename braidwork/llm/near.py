"""MinHash near-dedup by order MinHash: sketches sensitive to edit similarity, verified by banded alignment.

A text is its words (runs of letters and digits, lower-cased). Its 5-word k-mers are labelled with their occurrence
number, so repeated ones count as often as they stand. For each of SKETCHES orders the least labelled k-mer is taken, and
all of them are kept with their places: the sketch is several minima in the order of the text. A k-mer of one order is a
bucket. Texts are candidates if they share buckets of SHARED or more orders whose k-mers stand in the same order in both (the
covariance of their places is above 0): with Jaccard similarity 0.2 of their k-mers, as a fifth of the words substituted at
random leaves, two of 32 are shared with probability 0.993. Few k-mers of a short text survive an edit, so texts of up to
SHORT words have exact buckets besides, one of which is enough: their runs of words so long that similar texts share one.
Candidates are linked if the edit distance of their words, found inside a band, is at most a fifth of the longer.

Groups are the connected components of links. Exact copies are one node from the start, with the least id of that text as
its name, so that the least name of a component is that of its group. First each text is held against one of two texts of its
buckets, the least by name and the one whose own buckets are fullest, which of a family of copies is one with few edits: that
with which it shares most buckets. NEAREST times then against the one of another component in each of its buckets that is
nearest by its gauge; and at last every candidate pair is aligned that links do not join yet and whose lengths and gauges allow it. A
gauge counts a text's words by hash, and bounds the edit distance from below, so nothing is lost by it. Hot buckets are
dealt in blocks: those of the commonest component are held against those of the others, and these against each other; only
pairs that pass leave a task.

Edge cases: a null text counts as empty; texts without words are grouped only with their exact copies; a text of fewer
than five words is one k-mer; repeated rows are copies; ids that are null are ordered last; other columns are not read;
an empty table gives an empty result. Ties between hashes go to the earlier k-mer.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import bucketed, forget, fresh, partitions, written

K, SKETCHES, SHARED, SIMILAR, NEAREST = 5, 32, 2, 0.8, 1
#: A text of at most 30 words has similar ones of at most SHORT words.
SHORT = 37
#: Cells of a gauge (half a byte each), how many of them are one in its rough form, and members of a bucket that are dealt as
#: one block.
CELLS, FOLD, BLOCK = 256, 4, 512
#: Buckets of two members whose gauges are held against each other at a time.
COUPLES = 4096
#: Fixed odd multipliers of the orders, from a linear congruence.
SEEDS = np.array([(i * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64) | 1 for i in range(1, SKETCHES + 1)], np.uint64)
POWERS = 64
#: Power of two of the bits of the filter of wanted texts: 2 MB.
FILTER = 24


class _Letters:
    """Of each character of 16 bits its number and 1 if it is a letter or a digit, else 0; and powers by place in a word."""

    table: np.ndarray | None = None
    powers: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.table is None:
            cls.table = np.array([i + 1 if chr(i).isalnum() else 0 for i in range(65_536)], np.uint64)
            cls.powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(POWERS)], np.uint64)
        return cls.table, cls.powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    table, powers = _Letters.get()
    if text.isascii():
        a = np.frombuffer(text.lower().encode(), np.uint8)
        value = table.take(a)
    else:
        a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        value = np.where(a > 65_535, a.astype(np.uint64) + np.uint64(1), table.take(np.minimum(a, 65_535)))
    inside = np.zeros(len(a) + 2, bool)
    np.not_equal(value, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # What stands between words is 0, so its place after the word before plays no part.
    value = value[starts[0] :]
    place = np.arange(starts[0], len(a)) - np.repeat(starts, np.diff(starts, append=len(a)))
    if (ends - starts).max() <= POWERS:
        value *= powers.take(place, mode="clip")
    else:
        value *= powers.take(place % POWERS)
        value *= (place // POWERS * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, starts - starts[0]))


def kmers(w: np.ndarray, k: int = K) -> np.ndarray:
    k = min(k, len(w))
    if not k:
        return w
    h, factor = np.zeros(len(w) - k + 1, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        h *= factor
        h += w[i : i + len(h)]
    return mix(h)


def sketch(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SKETCHES buckets of the text with word hashes `w`, and the places of their k-mers; none if it has no words."""
    h = kmers(w)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    label, s = h, np.sort(h)
    if (s[1:] == s[:-1]).any():
        order = np.argsort(h, kind="stable")
        new = np.append(True, s[1:] != s[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = (np.arange(len(s)) - first).astype(np.uint64)
        label = h + occurrence * np.uint64(0x9E3779B97F4A7C15)
    labelled = mix(label) | np.uint64(1)
    out, place = np.empty(SKETCHES, np.uint64), np.empty(SKETCHES, np.int32)
    for lo in range(0, SKETCHES, step := max(1, min(SKETCHES, 2_000_000 // len(h)))):
        v = labelled[None, :] * SEEDS[lo : lo + step, None]
        v ^= v >> np.uint64(29)
        least = v.argmin(axis=1)
        place[lo : lo + step] = least
        out[lo : lo + step] = mix(np.arange(lo, lo + len(v)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + h[least])
    return out.view(np.int64), place


def marks(buckets: np.ndarray, places: np.ndarray) -> bytes:
    """A sketch by which two texts are compared: of each order 32 bits of its bucket, and the rank of its k-mer's place."""
    if not len(buckets):
        return bytes(5 * SKETCHES)
    rank = np.unique(places, return_inverse=True)[1].astype(np.uint8)
    return buckets.astype(np.uint32).tobytes() + rank.tobytes()


def alike(one: np.ndarray, rank_one: np.ndarray, two: np.ndarray, rank_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches, a row each: whether SHARED orders or more have the same k-mer, in the same order of their
    places; and the first of these orders (SKETCHES if none)."""
    same = one == two
    n = same.sum(axis=1)
    x, y = (np.where(same, a, 0).astype(np.int32) for a in (rank_one, rank_two))
    covariance = n * (x * y).sum(axis=1) - x.sum(axis=1) * y.sum(axis=1)
    return (n >= SHARED) & (covariance > 0), np.where(n > 0, same.argmax(axis=1), SKETCHES)


def runs(w: np.ndarray) -> np.ndarray:
    """Buckets of a text of at most SHORT words, of which any two similar texts share one; none for longer texts.

    If the longer of two similar texts has n words, n - n // 5 of them or more are unchanged and stand in n // 5 + 1 runs at
    most; so one run has 2 words at n = 5, 3 at 6 to 15, and 4 at 16 to SHORT. Below that, similar texts are equal.
    """
    n = len(w)
    lengths = [k for k, lo, hi in ((2, 4, 5), (3, 5, 15), (4, 13, SHORT)) if lo <= n <= hi]
    found = [mix(kmers(w, k) + np.uint64(k)) for k in lengths]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    Bit-parallel over a band: of each column only the 2 * most + 1 cells around the diagonal are kept, as differences in
    the bits of whole numbers; the score follows the band's lower edge, then the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    if not len(unlike):
        return len(a) - len(b)
    a, b = a[unlike[0] :], b[unlike[0] :]
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    cut = int(unlike[0]) if len(unlike) else n
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not len(b):
        return len(a)
    most = min(most, len(a))
    _, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    common = np.minimum(np.bincount(x, minlength=ids.max() + 1), np.bincount(y, minlength=ids.max() + 1)).sum()
    if len(a) - common > most:
        return most + 1
    where: dict[int, int] = {}
    for i, t in enumerate(x.tolist()):
        where[t] = where.get(t, 0) | 1 << i
    width = 2 * most + 2
    every, low = (1 << width) - 1, 1 << (width - 1)
    up, down, score, at = every & (every << (width - most - 1)), 0, most, most + 1 - width
    edge, turn, limit = low >> 1, len(a) - most, 2 * most + len(b) - len(a)
    for j, t in enumerate(y.tolist()):
        p = where.get(t, 0)
        p = (p >> at if at >= 0 else p << -at) & every
        d = ((((p & up) + up) ^ up) | p | down) & every
        hp = (down | ~(d | up)) & every
        hn = d & up
        if j < turn:
            score += not d & low
        else:
            score += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        if score > limit:
            return most + 1
        d >>= 1
        up, down = (hn | ~(d | hp)) & every, d & hp
        at += 1
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILAR) + 1e-9)
    return longer > 0 and distance(a, b, most) <= most


def gauge(w: np.ndarray) -> np.ndarray:
    """Counts of the words by hash, of 15 at most, two in a byte. What two gauges differ by, in the one direction or the other,
    their texts differ by; nor does a bound on counts, or their sum, add to it."""
    n = np.minimum(np.bincount((w % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 15).astype(np.uint8)
    return n[::2] << 4 | n[1::2]


def _cells(gauges: np.ndarray) -> np.ndarray:
    """Gauges, a row each, as counts."""
    out = np.empty((len(gauges), CELLS), np.int8)
    out[:, ::2], out[:, 1::2] = gauges >> 4, gauges & 15
    return out


def _gaps(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    d = rows - row
    total = d.sum(axis=1, dtype=np.int32)
    over = np.maximum(d, 0).sum(axis=1, dtype=np.int32)
    return np.maximum(over, over - total)


def digest() -> Column:
    """Names a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            text, size, found, sketches, gauges = [], [], [], [], []
            for t in b.column(1):
                t = t.as_py() or ""
                w = words(t)
                text.append(hashlib.sha256(t.encode()).digest()[:16])
                size.append(len(w))
                (buckets, at), exact = sketch(w), runs(w)
                found.append(np.concatenate([buckets, exact]))
                sketches.append(marks(buckets, at))
                gauges.append(gauge(w).tobytes())
            cols = [pa.array(text, pa.binary()), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(gauges, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "digest", "size", "buckets", "sketch", "gauge"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, size int, buckets array<long>, sketch binary, gauge binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. `texts` (node, words) is bucketed by node, and stays where it is."""

    def run(batches):
        read = lambda x: np.frombuffer(x.as_py(), np.uint32).astype(np.uint64)
        for b in batches:
            keep = [similar(read(x), read(y)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the least node of each connected component.

    Every round gives a node the least root among its neighbours' and then that root's own; each is written to the shared
    folder, so that a lost executor costs one round at most.
    """
    ways = [edges.select(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    both = written(ways[0].union(ways[1]).where("node <> other").distinct(), "edges")
    now = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    roots = now
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("seen"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("new"))
        jump = step.join(step.select(F.col("node").alias("_n"), F.col("new").alias("_r")), F.col("new") == F.col("_n"), "left")
        new = written(jump.select("node", "root", F.least("new", F.coalesce("_r", "new")).alias("new")), "roots")
        changed = new.where("root <> new").limit(1).count()
        forget(now)
        now, roots = new, new.select("node", F.col("new").alias("root"))
        if not changed:
            forget(both)
            return roots


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): only the components that they touch are gone through, each as one node."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    found = components(between)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    new = written(moved.unionByName(found.join(roots.select("node"), "node", "left_anti")), "roots")
    forget(found)
    forget(roots)
    return new


def _first(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each node of (bucket, node, lo, n) with that of two texts of its buckets that it shares most of them
    with: a bucket's least node, and the one whose buckets hold most."""
    full = members.groupBy("node").agg(F.sum("n").alias("full"))
    hubs = members.select("bucket", "node").join(full, "node").groupBy("bucket").agg(F.max(F.struct("full", "node")).alias("hub"))
    near = members.join(hubs, "bucket").select("node", F.explode(F.array("lo", "hub.node")).alias("end")).where("node <> end").groupBy("node", "end").agg(F.count(F.lit(1)).alias("n"))
    best = near.groupBy("node").agg(F.max(F.struct("n", "end")).alias("p"))
    return best.select(F.least("node", "p.end").alias("a"), F.greatest("node", "p.end").alias("b")).distinct()


def apart(root: np.ndarray, size: np.ndarray, gauges: np.ndarray, side: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the members of a bucket, or of two of its blocks (`side` 0 and 1), the pairs of different roots whose lengths and
    gauges allow a link; with `nearest` for each member only that whose gauge is nearest."""
    none = np.zeros(0, np.int64)
    codes, counts = np.unique(root, return_counts=True)
    if len(codes) < 2:
        return none, none
    # Each pair has a member outside the largest root: these come first, and each is held against those after it.
    order = np.argsort(root == codes[counts.argmax()], kind="stable")
    root, size, side = root[order], size[order], side[order]
    fine, cross = _cells(gauges[order]), side.any() and not side.all()
    rough = fine.reshape(len(fine), -1, FOLD).sum(axis=2, dtype=np.int8)
    found = []
    for i in range(len(root) - int(counts.max())):
        allowed = (np.maximum(size[i], size[i + 1 :]) * (1 - SIMILAR) + 1e-9).astype(np.int64)
        ok = (root[i + 1 :] != root[i]) & (np.abs(size[i + 1 :] - size[i]) <= allowed)
        if cross:
            ok &= side[i + 1 :] != side[i]
        at = np.flatnonzero(ok)
        if len(at):
            at = at[_gaps(rough[i + 1 + at], rough[i]) <= allowed[at]]
            gap = _gaps(fine[i + 1 + at], fine[i])
            keep = np.flatnonzero(gap <= allowed[at])
            if len(keep):
                found.append((np.full(len(keep), i), i + 1 + at[keep], gap[keep]))
    if not found:
        return none, none
    i, j, gap = (np.concatenate(x) for x in zip(*found, strict=True))
    if nearest:
        who, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        by = np.lexsort((gap[pair], who))
        pair = np.unique(pair[by[np.append(True, who[by][1:] != who[by][:-1])]])
        i, j = i[pair], j[pair]
    return order[i], order[j]


def couples(root: np.ndarray, size: np.ndarray, gauges: np.ndarray, i: np.ndarray) -> np.ndarray:
    """As apart() for buckets of two members, i and the next, all at once: which have different roots, and lengths and gauges that
    allow a link. Each of the two is nearest to the other, and their blocks play no part."""
    allowed = (np.maximum(size[i], size[i + 1]) * (1 - SIMILAR) + 1e-9).astype(np.int64)
    ok = (root[i] != root[i + 1]) & (np.abs(size[i] - size[i + 1]) <= allowed)
    i, allowed = i[ok], allowed[ok]
    found = [i[:0]]
    for lo in range(0, len(i), COUPLES):
        part = i[lo : lo + COUPLES]
        found.append(part[_gaps(_cells(gauges[part + 1]), _cells(gauges[part])) <= allowed[lo : lo + COUPLES]])
    return np.concatenate(found)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Of (bucket, node, ...) the rows of buckets that hold several components, with root, the commonest root of the bucket
    (major), and how many blocks its members (wide) and the others (many) make."""
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    of = each.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    of = of.where(F.col("all") > F.col("top.n")).select("bucket", F.col("top.root").alias("major"), blocks(F.col("top.n")).alias("wide"), blocks(F.col("all") - F.col("top.n")).alias("many"))
    return named.join(of, "bucket")


def _unjoined(opened: DataFrame, roots: DataFrame, gauges: DataFrame) -> DataFrame:
    """Pairs (a, b) that links do not join and that gauges (node, gauge) allow: with sketches (node, gauge, sketch) all
    candidates, without for each node the one of least gap in each block of its buckets."""
    nearest = "sketch" not in gauges.columns
    # Gauges come last, so that only the rows of blocks are moved with them.
    members = _open(opened, roots).join(gauges, "node")
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    own = dealt(F.col("many"))
    # Of the others each block is held against itself and every other, each two of them by themselves; and against each
    # block of the commonest component.
    others = F.concat(F.transform(upto("many"), lambda x: cell(0, F.least(own, x), F.greatest(own, x), own > x)), F.transform(upto("wide"), lambda x: cell(1, own, x, F.lit(False))))
    major = F.transform(upto("many"), lambda x: cell(1, x, dealt(F.col("wide")), F.lit(True)))
    # Where there is one block of each, both meetings are one cell, and no row is moved twice.
    both = F.array(cell(2, F.lit(0), F.lit(0), F.col("root") == F.col("major")))
    cells = members.withColumn("cell", F.explode(F.when(F.expr("many = 1 and wide = 1"), both).when(F.col("root") == F.col("major"), major).otherwise(others)))
    cells = cells.select("bucket", "place", *([] if nearest else ["sketch"]), F.col("cell.kind").alias("kind"), F.col("cell.lo").alias("lo"), F.col("cell.hi").alias("hi"), F.col("cell.side").alias("side"), "size", "node", "root", "gauge")
    # Among equal gaps the order of the nodes decides, not that in which rows come.
    dealt = cells.repartition("bucket", "kind", "lo", "hi").sortWithinPartitions("bucket", "kind", "lo", "hi", "node")

    def pairs(t: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        size, side = t.column("size").to_numpy().astype(np.int64), t.column("side").to_numpy(zero_copy_only=False)
        table = np.frombuffer(b"".join(t.column("gauge").to_pylist()), np.uint8).reshape(-1, CELLS // 2)
        place = t.column("place").to_numpy()
        if not nearest:
            all_ = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, 5 * SKETCHES)
            hashes, ranks = np.ascontiguousarray(all_[:, : 4 * SKETCHES]).view(np.uint32), all_[:, 4 * SKETCHES :]
        kind = t.column("kind").to_numpy()
        a, b = [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            if not nearest and len(i):
                # The buckets of a short text's runs come after those of its sketch. Of the others the first that both have
                # tells of a pair, so that no other does too.
                keep = []
                for lo in range(0, len(i), 20_000):
                    x, y = i[lo : lo + 20_000], j[lo : lo + 20_000]
                    ok, first = alike(hashes[x], ranks[x], hashes[y], ranks[y])
                    keep.append((place[x] >= SKETCHES) | (ok & (first == place[x])))
                i, j = i[np.concatenate(keep)], j[np.concatenate(keep)]
            a.append(np.minimum(node[i], node[j]))
            b.append(np.maximum(node[i], node[j]))

        # Most buckets have two members.
        many = np.diff(edges)
        two = couples(root, size, table, edges[:-1][many == 2])
        take(two, two + 1)
        for s, e in zip(edges[:-1][many > 2].tolist(), edges[1:][many > 2].tolist(), strict=True):
            met = [np.arange(s, e)]
            if kind[s] == 2:  # the others against the commonest component, and against each other
                met.append(s + np.flatnonzero(~side[s:e]))
            found = [(x, apart(root[x], size[x], table[x], side[x], nearest)) for x in met]
            take(*(np.concatenate([x[pair[k]] for x, pair in found]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])

    def run(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            t = b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            key = [t.column(c).to_numpy() for c in ("bucket", "kind", "lo", "hi")]
            change = np.flatnonzero(reduce(np.logical_or, [k[1:] != k[:-1] for k in key])) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield pairs(t.slice(0, last), np.append(0, change))
            kept = t.slice(last)  # may go on in the next batch
        if kept is not None:
            yield pairs(kept, np.array([0, kept.num_rows]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _classes(rows: DataFrame, *more: Column) -> DataFrame:
    """digest, class_id (the least id of the text) and `more`: a row for each text."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"), *more)


def _nodes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """digest, class_id, node, size, buckets, sketch, gauge: a row for each text. node is class_id, the least id of the text, or where
    that does not tell texts apart (told by the flag), a number in its order."""
    first = _classes(rows, F.first(F.struct("size", "buckets", "sketch", "gauge")).alias("s"))
    nodes = written(first.select("digest", "class_id", F.col("class_id").alias("node"), "s.*"), "nodes")
    odd = nodes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or class_id is null").limit(1).count()
    if not odd:
        return nodes, False
    ranked = nodes.orderBy(F.col("class_id").asc_nulls_last(), "digest").withColumn("node", F.monotonically_increasing_id())
    return written(ranked, "ranked"), True


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, ranked: bool) -> DataFrame:
    """(node, words) of the wanted nodes' texts, bucketed by node, as 32 bits of hash a word: that two unlike words count as one
    has a chance of 2^-32 for each two of a pair of texts. Rows whose id is that of no wanted text are
    mostly told by a filter of fixed size, before anything is moved. Where ids are nodes, texts are moved once: dealt as
    they stay."""
    of = wanted.join(nodes.select("node", "class_id", "digest"), "node")
    bits = of.select(F.shiftrightunsigned(F.xxhash64(F.lit(9), "class_id"), 64 - FILTER).alias("bit"))
    cells = bits.groupBy(F.expr("cast(shiftright(bit, 6) as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set"))
    bitmap = np.zeros(1 << (FILTER - 6), np.int64)
    found = cells.toArrow()  # 2^18 rows at most
    bitmap[found.column("at").to_numpy()] = found.column("set").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            h = b.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER)
            hit = (shared.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)).astype(np.int64)) & 1 == 1
            rows = b.filter(pa.array(hit))
            text, cut = rows.column(1).to_pylist(), []
            for t in text:
                cut.append((words(t) >> np.uint64(32)).astype(np.uint32).tobytes())
            names = [hashlib.sha256(t.encode()).digest()[:16] for t in text]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.binary()), pa.array(cut, pa.binary())], ["doc_id", "digest", "words"])

    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(9), "doc_id").alias("h")).mapInArrow(run, "doc_id long, digest binary, words binary")
    if ranked:
        met = some.join(of.select("node", "class_id", F.col("digest").alias("_d")), F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("_d")))
    else:
        dealt = some.withColumnRenamed("doc_id", "node").repartition(partitions(docs.sparkSession), "node")
        met = dealt.join(of.select("node", F.col("digest").alias("_d")), "node").where("digest between _d and _d")  # as an equality it would be a key, by which all were moved again
    return bucketed(met.select("node", "words"), "node", "texts")


def grouped(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest (names its text), class_id (the least id of that text), group_id (the least id of
    its group), n_links (links found between its text and others)."""
    nodes, ranked = _nodes(_sketched(docs))
    buckets = nodes.select("node", "size", F.posexplode("buckets").alias("place", "bucket"))
    of = Window.partitionBy("bucket")  # moves a bucket's rows once; counts beside them would be as many rows again
    seen = buckets.select("bucket", "node", "size", "place", F.min("node").over(of).alias("lo"), F.max("node").over(of).alias("hi"), F.count(F.lit(1)).over(of).alias("n"))
    members = written(seen.where("lo <> hi").drop("hi"), "members")
    texts = _texts(docs, nodes, members.select("node").distinct(), ranked)
    tried = written(_first(members), "pairs")
    edges = written(_verified(tried, texts), "links")
    roots = components(edges)
    opened = written(_open(members, roots).select("bucket", "node", "size", "place"), "open")
    forget(members)
    for nearest in [True] * NEAREST + [False]:
        more = _unjoined(opened, roots, nodes.select("node", "gauge", *["sketch"] * (not nearest))).join(tried, ["a", "b"], "left_anti")
        pairs = written(more, "pairs")
        if pairs.isEmpty():
            continue
        tried = tried.union(pairs)
        new = written(_verified(pairs, texts), "links")
        edges = edges.union(new)
        if not new.isEmpty():
            roots = _merged(roots, new)
    forget(opened)
    forget(texts)
    links = edges.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("digest", "class_id", "node").join(roots, "node", "left").join(links, "node", "left")
    known = known.select("digest", "class_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    least = nodes.select(F.col("node").alias("root"), F.col("class_id").alias("group_id"))
    known = known.join(least, "root") if ranked else known.withColumn("group_id", F.col("root"))
    return docs.select("doc_id", digest().alias("digest")).join(known, "digest").select("doc_id", "digest", "class_id", "group_id", "n_links")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of grouped(), for which no text has to be held against another."""
    rows = docs.select("doc_id", digest().alias("digest"))
    return rows.join(_classes(rows), "digest").select("doc_id", "class_id")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", "class_id", "group_id", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Of each group the row with the least id (of repeated rows one), with all columns of `docs`."""
    node, place, plan = fresh(docs, "_node"), fresh(docs, "_place"), fresh(docs, "_kept")
    found = grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select("doc_id", "digest").distinct()
    found = found.select(F.struct(F.col("doc_id").alias("i"), F.col("digest").alias("n")).alias(plan))
    rows = docs.withColumn(node, digest())
    on = [F.col("doc_id").eqNullSafe(F.col(f"{plan}.i")), F.col(node) == F.col(f"{plan}.n")]
    kept = rows.join(found, reduce(Column.__and__, on))
    one = Window.partitionBy("doc_id", node).orderBy(node)
    return kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns)
