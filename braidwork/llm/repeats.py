"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts earlier are removed.

The suffix array is sparse. Of the 61 strings of ANCHOR bytes within each LENGTH bytes, the one with the least hash (the
leftmost in ties) is the window's anchor; equal windows have equal anchors at equal places, so it is enough to sort the
suffixes at anchors, some 3 % of all. A suffix is sorted by the bytes after its anchor's start and then by those before it,
in reverse: all that any of its windows reaches.

1. Fingerprints of anchors meet by hash; those that occur twice set bits in a filter. Like the duplicate detection of
   distributed string sorters, it only spares suffixes that are alone; a false hit costs bytes, not truth. A second filter
   holds the hot anchors, that occur HOT times or more.
2. Each task sorts the suffixes left into runs. Of equal ones all but the first are repeats and go no further. The others are
   exchanged front-coded: the length of the prefix shared with the one before, and the rest. Sampled anchors cut the order of
   all suffixes into stretches, one for each part.
3. A loser tree merges a part's runs. It knows of every head how much it shares with the last output and compares two
   heads only beyond that; the merged suffixes come with the lengths that neighbours share.
4. Suffixes that share LENGTH - b bytes, by those lengths, and the b bytes before them, by a hash that the bytes confirm, have
   an equal window that begins b bytes before the anchor: all but the earliest are repeats.
5. A hot anchor may have as many contexts as there are documents, so its windows are dealt each by itself: their fingerprints
   meet as those of anchors do, each task drops the windows that it has seen, and the rest, sorted and front-coded as
   suffixes of LENGTH bytes, are dealt by their hash and merged. So no task gathers what a hot anchor has.

Edge cases: a null text counts as empty; texts shorter than LENGTH lose nothing; rows that repeat an id and text are one
document and get equal results; rows of one id with different texts, and rows without an id (last), are documents in the
order of their texts; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import partitions, written

LENGTH, ANCHOR = 100, 40
SPAN = LENGTH - ANCHOR + 1
LEFT, FULL = SPAN - 1, SPAN - 1 + LENGTH
#: Powers of two of the filter's bits: at least, and at most (128 MB); between, 4 to 8 for each anchor.
LEAST_BITS, MOST_BITS = 20, 30
#: Occurrences from which an anchor is hot; of one batch no more than MOST are counted.
HOT, MOST = 512, 100
#: Parts of the order for each partition, sampled anchors for each part, and suffixes in a run.
PARTS, SAMPLES, RUN = 2, 32, 100_000
#: Bytes handled at once, so that the arrays stay in a cache; below 2^20, as places share a word with hashes.
PIECE = 200_000
MULT = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(t: np.ndarray, length: int = ANCHOR) -> np.ndarray:
    """A hash of the `length` bytes from each place, by doubling."""
    h, size, kept = t.astype(np.uint64) + np.uint64(1), 1, {}
    power = lambda n: np.uint64(pow(MULT, n, 1 << 64))
    while size * 2 <= length:
        kept[size] = h
        h = h[: len(h) - size] * power(size) + h[size:]
        size *= 2
    rest = length - size
    for part in sorted(kept, reverse=True):
        if rest & part:
            k = kept[part]
            n = len(t) - size - part + 1
            h = h[:n] * power(part) + k[size : size + n]
            size += part
    return _mix(h)


def anchors(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of the anchors of `t`, texts that end at `ends` laid end to end: windows from `first` to
    `last` have it. Shorter than 2^20."""
    none = np.zeros(0, np.int64)
    if len(t) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = hashes(t)
    low = np.uint64((1 << 20) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < SPAN:
        key = np.minimum(key[: len(key) - (SPAN - size)], key[SPAN - size :])
    place = (key & low).astype(np.int64)
    at = np.arange(len(place))
    begins = np.append(0, ends[:-1])
    room = ends - begins
    ok = np.repeat(ends, room)[: len(place)] >= at + LENGTH
    at, place = at[ok], place[ok]
    if not len(at):
        return none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    last = at[np.append(new[1:], len(at)) - 1]
    return h[place[new]], place[new], at[new], last


def _pieces(texts: list[bytes]):
    """(bytes, ends, owners, offsets): short texts together; long ones cut with an overlap of LENGTH - 1, so that each of
    their windows lies in one piece."""
    group: list[int] = []
    size = 0

    def together():
        t = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        return t, np.cumsum([len(texts[i]) for i in group]), np.array(group), np.zeros(len(group), np.int64)

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > PIECE:
            whole = np.frombuffer(text, np.uint8)
            for lo in range(0, len(text) - LENGTH + 1, PIECE):
                part = whole[lo : lo + PIECE + LENGTH - 1]
                yield part, np.array([len(part)]), np.array([i]), np.array([lo])
            continue
        group.append(i)
        size += len(text)
        if size > PIECE:
            yield together()
            group, size = [], 0
    if group:
        yield together()


def hit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    bit = (h >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _anchored(texts: list[bytes], sieve: np.ndarray | None):
    """Per piece: the bytes, the anchors that pass the filter, and of each its text, the text's bounds and its place."""
    for t, ends, owners, offsets in _pieces(texts):
        h, place, first, last = anchors(t, ends)
        if sieve is not None and len(h):
            ok = hit(sieve, h)
            h, place, first, last = h[ok], place[ok], first[ok], last[ok]
        which = np.searchsorted(ends, place, side="right")
        yield t, h, place, first, last, owners[which], np.append(0, ends)[which], ends[which], offsets[which]


def _starts(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the anchors given by their first and last: where they begin, and the anchor's number."""
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def _contexts(t: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A row for each anchor: LENGTH bytes from its place on, then LEFT bytes before it in reverse; 0 beyond its text."""
    reach = np.append(np.arange(LENGTH), -1 - np.arange(LEFT))
    at = place[:, None] + reach[None, :]
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, t[np.clip(at, 0, len(t) - 1)], np.uint8(0))


def _shared(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before; 0 for the first."""
    unlike = rows[1:] != rows[:-1]
    return np.append(0, np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])).astype(np.uint8)


#: A stretch to remove; and what a suffix carries: document, place in it, and how many bytes before the place its first and
#: last window begin.
GONE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("stop", "<i4")])
META = np.dtype([("doc", "<i8"), ("place", "<i4"), ("far", "u1"), ("near", "u1")])


def gone(meta: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(meta), GONE)
    out["doc"], out["start"], out["stop"] = meta["doc"], meta["place"] - far.astype(np.int32), meta["place"] - near.astype(np.int32) + LENGTH
    return out


def joined(found: np.ndarray) -> np.ndarray:
    """Stretches of a document joined where they overlap or touch, in order."""
    if not len(found):
        return found
    found = found[np.lexsort((found["start"], found["doc"]))]
    shift = np.cumsum(np.append(False, found["doc"][1:] != found["doc"][:-1])).astype(np.int64) << 32
    end = np.maximum.accumulate(found["stop"] + shift)
    new = np.append(True, found["start"][1:] + shift[1:] > end[:-1])
    out = found[new]
    out["stop"] = (end & 0xFFFFFFFF)[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    return out


def encode(rows: np.ndarray, meta: np.ndarray) -> bytes:
    """A sorted run, front-coded: size, metadata, shared lengths, the rests of the rows."""
    shared = _shared(rows)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return struct.pack("<q", len(meta)) + meta.tobytes() + shared.tobytes() + rest.tobytes()


def decode(blob: bytes, width: int = FULL) -> tuple[list[bytes], list[int], np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    at = 8 + n * META.itemsize
    meta = np.frombuffer(blob, META, n, 8)
    shared = list(blob[at : at + n])
    at += n
    rows, row = [], b""
    for s in shared:
        row = row[:s] + blob[at : (at := at + width - s)]
        rows.append(row)
    return rows, shared, meta


def collapsed(rows: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and metadata in order, of equal ones the first only, and the stretches of the others."""
    if not len(rows):
        return rows, meta, np.zeros(0, GONE)
    order = np.lexsort((meta["place"], meta["doc"]))
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    rows, meta = rows[order], meta[order]
    copy = (_shared(rows) == rows.shape[1]) & np.append(False, (meta["far"][1:] == meta["far"][:-1]) & (meta["near"][1:] == meta["near"][:-1]))
    return rows[~copy], meta[~copy], gone(meta[copy], meta["far"][copy], meta["near"][copy])


def merge(runs: list[tuple[list[bytes], list[int]]], size: int = FULL) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs of rows of `size` bytes with their shared lengths: the (run, index) of each output, and how many
    bytes it shares with the output before.

    know[r] is what run r's head shares with the last output (for a head in the tree: with the one that beat it, which was
    put out since). The longer one is the lesser head; only of equally long ones are bytes compared, beyond those.
    """
    count = len(runs)
    if count == 1:
        return [(0, i) for i in range(len(runs[0][0]))], list(runs[0][1])
    width = 1 << (count - 1).bit_length()
    at = [0] * width
    know = [0 if r < count and runs[r][0] else -1 for r in range(width)]
    head: list[bytes] = [runs[r][0][0] if know[r] == 0 else b"" for r in range(width)]

    def beats(x: int, y: int) -> bool:
        """Whether x goes before y; sets what the loser shares with the winner."""
        kx, ky = know[x], know[y]
        if kx != ky:
            return kx > ky
        if kx < 0:
            return x < y
        a, b = head[x][kx:], head[y][kx:]
        if a == b:
            know[max(x, y)] = size
            return x < y
        diff = int.from_bytes(a) ^ int.from_bytes(b)
        same = kx + len(a) - (diff.bit_length() + 7) // 8
        if a < b:
            know[y] = same
            return True
        know[x] = same
        return False

    losers = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        up = []
        for i in range(level):
            x, y = winners[2 * i], winners[2 * i + 1]
            first = beats(x, y)
            losers[level + i] = y if first else x
            up.append(x if first else y)
        winners = up
    top, order, out = winners[0], [], []
    while know[top] >= 0:
        rows, shared = runs[top]
        i = at[top]
        order.append((top, i))
        out.append(know[top])
        at[top] = i = i + 1
        if i < len(rows):
            head[top], know[top] = rows[i], shared[i]
        else:
            know[top] = -1
        node = (width + top) >> 1
        while node:
            other = losers[node]
            if know[other] > know[top] or (know[other] == know[top] and not beats(top, other)):
                losers[node], top = top, other
            node >>= 1
    return order, out


def _merged(blobs: list[bytes], width: int):
    """A part's runs as one: rows as a function of a range, metadata, shared lengths."""
    runs = [decode(zlib.decompress(b), width) for b in blobs]
    order, shared = merge([(rows, s) for rows, s, _ in runs], width)
    base = np.append(0, np.cumsum([len(m) for *_, m in runs]))
    meta = np.concatenate([m for *_, m in runs])[np.array([base[r] + i for r, i in order], np.int64)]
    take = lambda lo, hi: np.frombuffer(b"".join(runs[r][0][i] for r, i in order[lo:hi]), np.uint8).reshape(-1, width)
    return take, meta, np.array(shared)


def repeated(blobs: list[bytes]) -> np.ndarray:
    """The stretches that one part's runs of suffixes say must go."""
    take, meta, shared = _merged(blobs, FULL)
    group = np.cumsum(shared < ANCHOR)
    found = [np.zeros(0, GONE)]
    for lo, hi in _cuts(group, 20_000):
        found.append(_windows(take(lo, hi), np.append(0, shared[lo + 1 : hi]), meta[lo:hi]))
    return np.concatenate(found)


def again(blobs: list[bytes]) -> np.ndarray:
    """The stretches of all but the earliest of each of the windows in one part's runs."""
    _, meta, shared = _merged(blobs, LENGTH)
    group = np.cumsum(shared < LENGTH)
    by = np.lexsort((meta["place"], meta["doc"], group))
    late = by[np.append(False, group[by][1:] == group[by][:-1])]
    return gone(meta[late], meta["far"][late], meta["near"][late])


def _cuts(group: np.ndarray, size: int):
    """Ranges of about `size` rows that end where groups end."""
    lo = 0
    while lo < len(group):
        hi = int(np.searchsorted(group, group[min(lo + size, len(group)) - 1], side="right"))
        yield lo, hi
        lo = hi


def _windows(rows: np.ndarray, shared: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Of rows in order, with the lengths that neighbours share, the stretches of windows that begin earlier too."""
    group = np.cumsum(shared < ANCHOR)
    alone = np.bincount(group)[group] < 2
    if alone.all():
        return np.zeros(0, GONE)
    several = np.flatnonzero(~alone)
    rows, shared, meta, group = rows[several], shared[several], meta[several], group[several]
    by = np.lexsort((meta["place"], meta["doc"], group))
    seen = np.zeros((len(rows), SPAN), bool)
    before = np.zeros(len(rows), np.uint64)  # a hash of the bytes before the anchor that the window has
    for back in range(SPAN):
        if back:
            before = before * np.uint64(MULT) + rows[:, LENGTH + back - 1] + np.uint64(1)
        ok = (meta["near"] <= back) & (back <= meta["far"])
        sel = by[ok[by]]
        if len(sel) < 2:
            continue
        after = np.cumsum(shared < LENGTH - back)  # equal for rows that share the bytes after
        h = _mix(before[sel] ^ _mix(after[sel].astype(np.uint64) * np.uint64(MULT)))
        rank = np.argsort(h, kind="stable")
        s = h[rank]
        new = np.append(True, s[1:] != s[:-1])
        if new.all():
            continue
        first = sel[rank[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]]
        late, origin = sel[rank[~new]], first[~new]
        like = (after[late] == after[origin]) & (rows[late, LENGTH : LENGTH + back] == rows[origin, LENGTH : LENGTH + back]).all(axis=1)
        seen[late[like], back] = True
        if not like.all():  # Different strings with one hash: settled by the strings themselves.
            met = set()
            for i in sel[np.isin(h, h[np.isin(sel, late[~like])])]:
                key = (after[i], rows[i, LENGTH : LENGTH + back].tobytes())
                seen[i, back] = key in met
                met.add(key)
    edge = np.diff(np.pad(seen, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return gone(meta[row], far - 1, near)


def _bytes(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _bits(docs: DataFrame, find, bits: int, levels: list[int], parts: int) -> list[np.ndarray]:
    """Filters of 2^bits bits: for each level the hashes of which `find` (texts to hashes and a sample) gives so many, and
    the samples, sorted. Each part of the hashes has its own stretch of the filters, and no more reaches the driver."""
    cut = min(bits - 3, (parts - 1).bit_length())
    stretch = 1 << (bits - cut)

    def emit(batches):
        for b in batches:
            h, sample = find(_bytes(b.column(1)))
            found, count = np.unique(h, return_counts=True)
            found = np.repeat(found, np.minimum(count, MOST))
            edges = np.searchsorted((found >> np.uint64(63 - cut) >> np.uint64(1)).astype(np.int64), np.arange((1 << cut) + 1))
            keep = np.flatnonzero(np.diff(edges))
            blobs = [found[edges[i] : edges[i + 1]].tobytes() for i in keep]
            keep, blobs = ([*keep, -1], [*blobs, sample]) if sample else (keep, blobs)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(blobs, pa.binary())], ["part", "found"])

    def count(table: pa.Table) -> pa.Table:
        part, blob = table.column("part")[0].as_py(), b"".join(x.as_py() for x in table.column("found"))
        if part < 0:
            return pa.table({"part": pa.array([part], pa.int32()), "set": pa.array([[blob]], pa.list_(pa.binary()))})
        h, n = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
        sets = []
        for least in levels:
            flags = np.zeros(stretch, bool)
            flags[(h[n >= least] >> np.uint64(64 - bits)).astype(np.int64) - part * stretch] = True
            sets.append(np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "set": pa.array([sets], pa.list_(pa.binary()))})

    found = docs.mapInArrow(emit, "part int, found binary").repartition(parts, "part").groupBy("part").applyInArrow(count, "part int, set array<binary>")
    out, sample = [np.zeros(1 << (bits - 3), np.uint8) for _ in levels], b""
    for r in found.toLocalIterator(prefetchPartitions=True):
        if r["part"] < 0:
            sample = r["set"][0]
            continue
        for bitmap, flags in zip(out, r["set"], strict=True):
            bitmap[r["part"] * (stretch >> 3) :][: stretch >> 3] = np.frombuffer(flags, np.uint8)
    return [*out, np.sort(np.frombuffer(sample, f"S{ANCHOR}"))]


def filters(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors those that repeat and those that are hot, of hot anchors' windows those that repeat, and the splitters of
    `parts` stretches of the order. Sizes follow the bytes of all texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = 2 * size // (SPAN + 1) + 1
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * expected).bit_length()))
    share = min(1.0, SAMPLES * parts / expected)

    def fingerprints(texts):
        all_, strings = [np.zeros(0, np.uint64)], []
        for t, h, place, *_ in _anchored(texts, None):
            all_.append(h)
            # Which anchors are in the sample only moves the splitters, not what is found.
            chosen = place[_mix(h ^ np.arange(len(h), dtype=np.uint64) * np.uint64(MULT)) < np.uint64(min(2**64 - 1, int(share * 2**64)))]
            strings.append(t[chosen[:, None] + np.arange(ANCHOR)].tobytes())
        return np.concatenate(all_), b"".join(strings)

    repeat, hot, sample = _bits(docs, fingerprints, bits, [2, HOT], partitions(docs.sparkSession))
    splitters = sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1]] if len(sample) >= parts else sample
    if not hot.any():
        return repeat, hot, np.zeros(1 << (LEAST_BITS - 3), np.uint8), splitters
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def windows(texts):
        all_ = [np.zeros(0, np.uint64)]
        for t, _, _, first, last, *_ in _anchored(texts, shared.value):
            if len(first):
                all_.append(hashes(t, LENGTH)[_starts(first, last)[0]])
        return np.concatenate(all_), b""

    several, _ = _bits(docs, windows, bits, [2], partitions(docs.sparkSession))
    shared.unpersist()
    return repeat, hot, several, splitters


def stretches(docs: DataFrame, parts: int) -> DataFrame:
    """(doc, gone): per document the stretches that must go, as pairs of 32-bit numbers."""
    spark = docs.sparkSession
    shared, buckets = spark.sparkContext.broadcast(filters(docs, parts)), partitions(spark)

    def deal(found: np.ndarray):
        """Stretches by bucket of documents, where they meet at last."""
        found = joined(found)
        bucket = (_mix(found["doc"].astype(np.uint64) * np.uint64(MULT)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        keep = np.flatnonzero(np.diff(edges))
        return keep, [found[order[edges[i] : edges[i + 1]]].tobytes() for i in keep]

    def emit(batches):
        repeat, hot, several, splitters = shared.value
        for b in batches:
            ids = b.column(0).to_numpy()
            suffixes, windows, late, held = [], [], [], 0
            for t, h, place, first, last, owner, lo, hi, offset in _anchored(_bytes(b.column(1)), repeat):
                m = np.zeros(len(h), META)
                m["doc"], m["place"] = ids[owner], place - lo + offset
                m["far"], m["near"] = place - first, place - last
                often = hit(hot, h)
                if often.any():
                    w, wm, more = _seen(t, first[often], last[often], place[often], m[often], several)
                    windows.append((w, wm))
                    late.append(more)
                    h, place, lo, hi, m = (x[~often] for x in (h, place, lo, hi, m))
                    held += len(wm)
                suffixes.append((_contexts(t, place, lo, hi), m))
                held += len(m)
                if held > RUN:
                    yield runs(suffixes, windows, late, splitters)
                    suffixes, windows, late, held = [], [], [], 0
            if suffixes:
                yield runs(suffixes, windows, late, splitters)

    def runs(suffixes, windows, late, splitters):
        """Sorted runs for the parts: of suffixes by their place in the order, then of windows by hash, then stretches."""
        keep, blobs = [], []
        for kind, found in enumerate((suffixes, windows)):
            if not found:
                continue
            rows, meta, more = collapsed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            late.append(more)
            if kind:
                part = (hashes(rows.ravel(), LENGTH)[::LENGTH] % np.uint64(parts)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
                order = np.argsort(part, kind="stable")
                rows, meta, part = rows[order], meta[order], part[order]
            else:
                part = np.searchsorted(splitters, np.ascontiguousarray(rows[:, :ANCHOR]).view(f"S{ANCHOR}").ravel(), side="right")
            edges = np.searchsorted(part, np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(edges)):
                keep.append(int(i) + kind * parts)
                blobs.append(zlib.compress(encode(rows[edges[i] : edges[i + 1]], meta[edges[i] : edges[i + 1]]), 1))
        at, found = deal(np.concatenate(late))
        return pa.RecordBatch.from_arrays([pa.array([*keep, *(at + 2 * parts)], pa.int32()), pa.array([*blobs, *found], pa.binary())], ["part", "run"])

    def settle(batches):
        now, blobs = None, []
        for b in batches:
            for part, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != now and blobs:
                    yield settled(now, blobs)
                    blobs = []
                now = part
                blobs.append(run.as_py())
        if blobs:
            yield settled(now, blobs)

    def settled(part: int, blobs: list[bytes]):
        if part >= 2 * parts:
            at, found = [part - 2 * parts], [b"".join(blobs)]
        else:
            at, found = deal(repeated(blobs) if part < parts else again(blobs))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found, pa.binary())], ["bucket", "gone"])

    def join(batches):
        """All stretches of a bucket of documents: one row for each of them."""
        found = joined(np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column(1)), GONE))
        at = np.flatnonzero(np.append(True, found["doc"][1:] != found["doc"][:-1])) if len(found) else np.zeros(0, int)
        pairs = np.stack([found["start"], found["stop"]], axis=1)
        blobs = [p.tobytes() for p in np.split(pairs, at[1:])] if len(found) else []
        yield pa.RecordBatch.from_arrays([pa.array(found["doc"][at], pa.int64()), pa.array(blobs, pa.binary())], ["doc", "gone"])

    # Parts go to partitions in turn, as a hash would leave some partitions many of them and some none.
    sent = docs.mapInArrow(emit, "part int, run binary").repartitionById(buckets, F.col("part") % buckets).sortWithinPartitions("part")
    found = sent.mapInArrow(settle, "bucket int, gone binary")
    return found.repartitionById(buckets, "bucket").mapInArrow(join, "doc long, gone binary")


def _seen(t: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, meta: np.ndarray, several: np.ndarray):
    """Windows of hot anchors in one piece that repeat somewhere: rows and metadata of the earliest of equal ones, and the
    stretches of the others."""
    start, which = _starts(first, last)
    h = hashes(t, LENGTH)[start]
    ok = hit(several, h)
    start, which, h = start[ok], which[ok], h[ok]
    m = meta[which]
    m["place"] += (start - place[which]).astype(np.int32)
    m["far"] = m["near"] = 0
    order = np.lexsort((m["place"], m["doc"], h))
    start, h, m = start[order], h[order], m[order]
    rows = t[start[:, None] + np.arange(LENGTH, dtype=np.int32)]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    origin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    # One hash, other bytes: kept, for the sort to tell.
    copy = ~new & (rows == rows[origin]).all(axis=1)
    return rows[~copy], m[~copy], gone(m[copy], m["far"][copy], m["near"][copy])


def removed(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): these, and `spans`, the maximal stretches of bytes to remove."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if odd:
        # Ids must tell documents apart, in order: numbers that grow from one stretch of the sorted table to the next do.
        each = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
        ranked = each.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("doc", F.monotonically_increasing_id())
        rows = written(ranked, "repeats-documents")
    else:
        rows = rows.withColumn("doc", F.col("doc_id"))
    gone = written(stretches(rows.select("doc", "text"), PARTS * partitions(docs.sparkSession)), "repeats-stretches")
    found = rows.join(gone, "doc", "left")
    return (found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))) if odd else found).select("doc_id", "text", "gone")


def kept(text: str, gone: bytes | None) -> tuple[bytes, bytes, np.ndarray]:
    """The text's bytes, those kept, and the maximal stretches removed."""
    t = text.encode("utf-8", "surrogatepass")
    spans = np.frombuffer(gone or b"", np.int32).reshape(-1, 2)
    at, out = 0, []
    for lo, hi in spans.tolist():
        out.append(t[at:lo])
        at = hi
    return t, b"".join([*out, t[at:]]), spans


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the bytes kept."""

    def run(batches):
        for b in batches:
            rows = []
            for text, gone in zip(b.column(1), b.column(2), strict=True):
                t, left, spans = kept(text.as_py(), gone.as_py())
                rows.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
