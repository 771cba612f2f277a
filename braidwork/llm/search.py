"""Exact top-k search: BM25 over inverted indexes of shards with block-max pruning, merged with global statistics.

Documents are cut into words once and written. A shard is an inverted index of some documents in the memory of a task, in
blocks of BLOCK documents. For a query the greatest weights of its terms in a block add up to a bound, and only blocks whose
bound reaches the least score that matters are scored. That score is known from the start: a SEEDS-th of the documents is
searched first, and its k-th best score is a lower bound for all others. The COMMON commonest terms of a shard are a matrix for
each block: their bounds are one product for many queries and all blocks, their scores one for each block and the queries that
have not passed it over. Rarer terms stand in few documents of a block, so that a block's greatest weight costs as much as the
postings themselves: their part of the scores is added up first, and bounds hold it as it is. Document frequencies, the number
and the mean length of documents are global, so shards' scores compare and the best k of all shards' best are the best k.
Documents of a shard are ordered by their commonest word, which tightens the bounds, and queries are taken in the same order.

Queries come in sets of at most PAIRS words with counts; one set at a time is broadcast, and the shards are gone through once
for each.

Edge cases: null and empty texts match nothing; a query without words or without an id has no results; different rows of one
query id are one query, whose words count together, and equal ones count once; equal scores are ranked by id (nulls last);
repeated rows are documents of their own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import forget, partitions, running, written
from braidwork.llm.near import words

K1, B, TOP = 1.2, 0.75, 10
BLOCK, DOCUMENTS, WORDS = 64, 8_192, 4_000_000
#: Terms of a shard that are kept as a matrix; the share searched first.
COMMON, SEEDS = 512, 16
PAIRS = 2_000_000
#: Documents cut at a time.
HELD = 512


def _terms(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct word hashes, their counts, and the number of words."""
    w = words(text or "").view(np.int64)
    t, n = np.unique(w, return_counts=True)
    return t, n, len(w)


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, few, terms, times, words): each document's distinct words, their counts and the number of words, and whether it is
    of those searched first; written, so that texts are cut once however many sets of queries there are."""

    def cut(batches):
        for whole in batches:
            # Few rows at a time, as an Arrow batch of long texts has many words.
            for lo in range(0, whole.num_rows, HELD):
                b = whole.slice(lo, HELD)
                found = [(t.tobytes(), n.astype(np.int32).tobytes(), size) for t, n, size in (_terms(x.as_py()) for x in b.column(2))]
                cols = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "few", "terms", "times", "words"])

    few = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(SEEDS)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), few.alias("few"), "text")
    return written(rows.mapInArrow(cut, "doc_id long, few boolean, terms binary, times binary, words long"), "search-documents")


def statistics(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) for all terms of the queries; the number of documents, and their mean length; `docs` as from parsed()."""
    parts = partitions(docs.sparkSession)

    def emit(batches):
        for b in batches:
            found = [np.frombuffer(t.as_buffer(), np.int64) for t in b.column(0)]
            term, df = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            part = (term.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            term, df, part = term[order], df[order].astype(np.int32), part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            keep = np.flatnonzero(np.diff(edges))
            cut = lambda a: [a[edges[i] : edges[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(cut(term), pa.binary()), pa.array(cut(df), pa.binary())], ["part", "terms", "df"])

    def add(table: pa.Table) -> pa.Table:
        term = np.frombuffer(b"".join(x.as_py() for x in table.column("terms")), np.int64)
        df = np.frombuffer(b"".join(x.as_py() for x in table.column("df")), np.int32)
        t, at = np.unique(term, return_inverse=True)
        return pa.table({"term": t, "df": np.bincount(at, df, len(t)).astype(np.int64)})

    sent = docs.select("terms").mapInArrow(emit, "part int, terms binary, df binary")
    found = written(sent.groupBy("part").applyInArrow(add, "term long, df long"), "search-df")
    n, length = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    wanted = queries.select("term").distinct()
    return found.join(wanted, "term"), n, length / n if n else 0.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n) from (query_id, text)."""

    def emit(batches):
        for b in batches:
            for q, t in zip(b.column(0), b.column(1), strict=True):
                terms, n, _ = _terms(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([q.as_py()] * len(terms), pa.int64()), pa.array(terms), pa.array(n.astype(np.int32))], ["query_id", "term", "n"])

    rows = queries.where("query_id is not null").select("query_id", "text").distinct()
    found = rows.mapInArrow(emit, "query_id long, term long, n int")
    return found.groupBy("query_id", "term").agg(F.sum("n").cast("int").alias("n"))


class Shard:
    def __init__(self, terms: np.ndarray, idf: np.ndarray, mean: float):
        self.terms, self.idf, self.mean = terms, idf, mean
        self.docs: list = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.lengths: list[int] = []
        self.words = 0

    def add(self, doc: int | None, text: str | None) -> None:
        self.put(doc, *_terms(text))

    def put(self, doc: int | None, t: np.ndarray, n: np.ndarray, length: int) -> None:
        at = np.searchsorted(self.terms, t)
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == t[ok]
        self.docs.append(doc)
        self.parts.append((at[ok].astype(np.int32), n[ok].astype(np.int32)))
        self.lengths.append(length)
        self.words += len(t)

    def full(self) -> bool:
        return len(self.docs) >= DOCUMENTS or self.words >= WORDS

    def seal(self) -> None:
        common = np.array([p[0][p[1].argmax()] if len(p[0]) else -1 for p in self.parts])
        order = np.lexsort((np.array(self.lengths), common))
        self.docs = [self.docs[i] for i in order]
        self.ids = np.array([np.iinfo(np.int64).max if d is None else d for d in self.docs], np.int64)
        sizes = np.array([len(self.parts[i][0]) for i in order])
        self.blocks = -(-len(order) // BLOCK)
        none = [np.zeros(0, np.int32)]
        # By document, for the scores that are returned.
        self.of = np.append(0, np.cumsum(sizes))
        self.term = np.concatenate([self.parts[i][0] for i in order] or none)
        self.n = np.concatenate([self.parts[i][1] for i in order] or none)
        self.parts = []
        self.norm = K1 * (1 - B + B * np.array(self.lengths, float)[order] / max(self.mean, 1e-9))
        # The commonest terms as a matrix for each block, and the greatest weight of each in it.
        count = np.bincount(self.term, minlength=len(self.terms))
        top = np.argsort(-count, kind="stable")[:COMMON]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[top] = np.arange(len(top))
        self.matrix = np.zeros((self.blocks, len(top), BLOCK), np.float32)
        rare = []
        for lo in range(0, len(order), BLOCK):
            place = slice(self.of[lo], self.of[min(lo + BLOCK, len(order))])
            doc = np.repeat(np.arange(lo, min(lo + BLOCK, len(order))), sizes[lo : lo + BLOCK])
            weight, c = self._weights(place, doc), self.column[self.term[place]]
            self.matrix[lo // BLOCK, c[c >= 0], doc[c >= 0] - lo] = weight[c >= 0]
            rare.append((self.term[place][c < 0], doc[c < 0].astype(np.int32), weight[c < 0].astype(np.float32)))
        self.most = np.ascontiguousarray(self.matrix.max(axis=2).T)
        # The others as postings.
        term, doc, weight = (np.concatenate(x) for x in zip(*rare, strict=True))
        by = np.argsort(term, kind="stable")
        # A posting is one number, so that memory is met once: the document above, the weight's bits below.
        self.post = doc[by].astype(np.int64) << 32 | weight[by].view(np.uint32)
        self.first = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
        self.times = np.zeros(len(self.terms))

    def _weights(self, place: slice | np.ndarray, doc: np.ndarray) -> np.ndarray:
        n = self.n[place]
        return self.idf[self.term[place]] * n * (K1 + 1) / (n + self.norm[doc])

    def best(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (terms, times, least score asked for) the k best (score to six places, index in docs) with a score
        above 0; ties go to the lesser id."""
        dense = np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        scores = np.zeros((len(queries), self.blocks, BLOCK), np.float32)
        for i, (t, n, _) in enumerate(queries):
            c = self.column[t]
            dense[i, c[c >= 0]] = n[c >= 0]
            scores[i] = self._rare(t[c < 0], n[c < 0]).reshape(-1, BLOCK)
        # With room for the rounding of single precision.
        asked = np.array([max(1e-6, least * (1 - 1e-4) - 1e-5) for _, _, least in queries], np.float32)
        open_ = dense @ self.most + scores.max(axis=2) >= asked[:, None]
        for b in np.flatnonzero(open_.any(axis=0)):
            chosen = np.flatnonzero(open_[:, b])
            if len(chosen) > 0.8 * len(queries):
                scores[:, b] += dense @ self.matrix[b]
            else:
                scores[chosen, b] += dense[chosen] @ self.matrix[b]
        # A block passed over keeps a part of its scores, which is below what is asked for.
        return [self._exact(s.ravel(), t, n, a, least, k) for s, (t, n, least), a in zip(scores, queries, asked, strict=True)]

    def _rare(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The rarer terms' part of all documents' scores, from their postings."""
        lo = self.first[terms]
        size = self.first[terms + 1] - lo
        end = np.cumsum(size)
        at = np.repeat(lo - (end - size), size)
        at += np.arange(len(at))
        post = self.post.take(at)
        worth = post.astype(np.uint32).view(np.float32)
        many = times > 1
        if many.any():
            worth *= np.repeat(times.astype(np.float32), size)
        post >>= 32
        return np.bincount(post, worth, self.blocks * BLOCK)

    def _exact(self, s: np.ndarray, terms: np.ndarray, times: np.ndarray, asked: float, least: float, k: int) -> list[tuple[float, int]]:
        near = np.flatnonzero(s >= asked)
        if len(near) > k:
            near = near[s[near] >= np.partition(s[near], -k)[-k] * (1 - 1e-4) - 1e-5]
        if not len(near):
            return []
        self.times[terms] = times
        size = self.of[near + 1] - self.of[near]
        at = np.repeat(self.of[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        exact = np.round(np.add.reduceat(self.times[self.term[at]] * self._weights(at, np.repeat(near, size)), np.cumsum(size) - size), 6)
        self.times[terms] = 0
        order = np.lexsort((self.ids[near], -exact))[:k]
        return [(float(exact[i]), int(near[i])) for i in order if exact[i] > 0 and exact[i] >= least]


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): for each of `queries` (query_id, text) the k best of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    asked = written(query_terms(queries), "search-queries")
    docs = parsed(docs)
    stats, count, mean = statistics(docs, asked)
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "search-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = running(sizes.withColumn("one", F.lit(1)), ["one"], ["query_id"], "n", "at", partitions(spark))
    numbered = placed.select("query_id", F.floor(F.col("at") / PAIRS).alias("set"))
    weighted = written(asked.join(numbered, "query_id").join(stats, "term"), "search-terms")
    schema = "query_id long, rank int, doc_id long, score double"
    out = spark.createDataFrame([], schema)
    for number in range(-(-total // PAIRS)):
        table = weighted.where(F.col("set") == number).select("query_id", "term", "n", "df").toArrow()
        if table.num_rows:
            out = out.unionByName(_searched(docs, table, count, mean, k))
    forget(docs)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _searched(docs: DataFrame, table: pa.Table, count: int, mean: float, k: int) -> DataFrame:
    """The results of one set of queries, written."""
    query, term, n, df = (table.column(c).to_numpy() for c in ("query_id", "term", "n", "df"))
    terms, at = np.unique(term, return_inverse=True)
    frequency = np.zeros(len(terms))
    frequency[at] = df
    idf = np.log(1 + (count - frequency + 0.5) / (frequency + 0.5))
    order = np.argsort(query, kind="stable")
    ids, first = np.unique(query[order], return_index=True)
    # Queries go together by their commonest term, as documents do, so that they ask for the same blocks.
    most = np.lexsort((-n, query))[first]
    turn = np.argsort(at[most], kind="stable")
    index = (terms, idf, ids, np.append(first, len(order)), at[order].astype(np.int32), n[order], turn)
    del table, query, term, df, frequency, order
    spark, least = docs.sparkSession, np.zeros(len(ids))
    shared = spark.sparkContext.broadcast(index)
    # A shard for each core at least, and as few beyond that as hold all documents: each costs every query a little.
    tasks = lambda rows: max(spark.sparkContext.defaultParallelism, -(-5 * rows // (4 * DOCUMENTS)))
    some = docs.where("few").repartition(tasks(count // SEEDS))
    seeds = written(_ranked(_shards(some, shared, least, mean, k), k), "search-seeds")
    known = seeds.where(F.col("rank") == k).select("query_id", "score").toArrow()
    least[np.searchsorted(ids, known.column(0).to_numpy())] = known.column(1).to_numpy()
    rest = _shards(docs.where("not few").coalesce(tasks(count)), shared, least, mean, k)
    found = written(_ranked(seeds.drop("rank").unionByName(rest), k), "search-found")
    forget(seeds)
    shared.destroy()
    return found


def _shards(docs: DataFrame, shared, least: np.ndarray, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): for each task and query the k best of its documents with the least score or more."""
    asked = docs.sparkSession.sparkContext.broadcast(least)

    def run(batches):
        terms, idf, ids, first, at, n, turn = shared.value
        floor = asked.value.copy()
        best: list[list[tuple[float, int, int | None]]] = [[] for _ in ids]

        def search(shard):
            shard.seal()
            for lo in range(0, len(ids), 128):
                part = turn[lo : lo + 128]
                found = shard.best([(at[first[i] : first[i + 1]], n[first[i] : first[i + 1]], floor[i]) for i in part], k)
                for i, rows in zip(part, found, strict=True):
                    if rows:
                        more = [(-s, int(shard.ids[d]), shard.docs[d]) for s, d in rows]
                        best[i] = sorted(best[i] + more, key=lambda r: r[:2])[:k] if best[i] else more
                        if len(best[i]) == k:
                            floor[i] = max(floor[i], -best[i][-1][0])

        shard = Shard(terms, idf, mean)
        for b in batches:
            for doc, t, times, size in zip(*b.columns, strict=True):
                shard.put(doc.as_py(), np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int32), size.as_py())
                if shard.full():
                    search(shard)
                    shard = Shard(terms, idf, mean)
        if shard.docs:
            search(shard)
        rows = [(int(ids[i]), doc, -s) for i, found in enumerate(best) for s, _, doc in found]
        for lo in range(0, len(rows), 100_000):
            cols = list(zip(*rows[lo : lo + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "doc_id", "score"])

    return docs.select("doc_id", "terms", "times", "words").mapInArrow(run, "query_id long, doc_id long, score double")


def report(docs: DataFrame) -> DataFrame:
    """The TOP best documents for the text of every document whose id is divisible by 50."""
    return search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))
