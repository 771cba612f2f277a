"""Document fingerprints: homomorphic multiset hashes, sums of wide vectors hashed from paragraphs.

A paragraph (a line) contributes two vectors. Its identity: sixteen 32-bit numbers from its SHA-512, summed modulo 2^32;
texts with the same paragraphs in any order have equal sums, and a paragraph can be added or taken away without the
rest. Its outline: for each three consecutive words of it, 128 signs drawn from their hash; how many of them were
positive is summed modulo 2^32, with the number of triples; from two such sums follows the cosine of the texts' triples
counted as vectors, up to noise of about 0.09. A fingerprint is the text of both, comma-joined:
`<number of paragraphs>,<triples>,<16 identity lanes>,<64 outline lanes, each two counts>`.

Everything is a DataFrame expression; no text leaves the JVM.

Edge cases: a null text counts as empty, which is one empty paragraph; a paragraph of fewer than three words gives one
triple of what there is; repeated rows are documents of their own, next to each other; null ids come last in the
descending order; other columns are not read; an empty table gives an empty result; a single row is its own next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import partitions

LANES, WORDS = 16, 2
#: Bits of a hash that one long holds as two counters of 32 bits.
PAIRS = 0x0000000100000001
SLOTS = [(w, j) for w in range(WORDS) for j in range(32)]


def _paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(paragraphs: Column) -> Column:
    """Sixteen sums modulo 2^32 over the paragraphs' SHA-512."""
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 512))
    hashed = F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.aggregate(hashed, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).bitwiseAND(F.lit(0xFFFFFFFF))))


def _triples(paragraphs: Column) -> Column:
    """A hash of each three consecutive words of a paragraph."""

    # Each step binds its array to a lambda's variable, else it would be computed again for each element.
    words = F.transform(paragraphs, lambda p: F.transform(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    triples = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.flatten(F.transform(words, triples))


def _counts(h: Column) -> list[Column]:
    """Sums over rows of the bits of the hash `h` and of a second hash of it, two in each long."""
    two = [h, F.xxhash64(h, F.lit(1))]
    return [F.sum(F.shiftrightunsigned(two[w], j).bitwiseAND(F.lit(PAIRS))).alias(f"c{w}_{j}") for w, j in SLOTS]


def fingerprints(df: DataFrame, keys: list[str], text: str, carry: list[str]) -> DataFrame:
    """keys, carry, n_paragraphs, n_triples, identity (array), outline (array) for each row; `keys` must tell rows apart.
    Nothing is shuffled if `df` is already partitioned by some of the keys."""
    parts = df.withColumn("_p", _paragraphs(F.col(text)))
    # Before the explode, not in its select: what stands there is computed for each row that comes out.
    parts = parts.select(*keys, *carry, F.size("_p").cast("long").alias("n_paragraphs"), _identity(F.col("_p")).alias("identity"), _triples(F.col("_p")).alias("_t"))
    parts = parts.select(*keys, *carry, "n_paragraphs", "identity", F.explode("_t").alias("_h"))
    # What is carried stands among the keys: with sums of longs alone the aggregate is by hash and needs no sort.
    summed = parts.groupBy(*keys, *carry, "n_paragraphs", "identity").agg(F.count(F.lit(1)).alias("n_triples"), *_counts(F.col("_h")))
    outline = F.array(*[F.col(f"c{w}_{j}") for w, j in SLOTS]).alias("outline")
    return summed.select(*keys, *carry, "n_paragraphs", "n_triples", "identity", outline)


def as_text(prefix: str = "") -> Column:
    numbers = F.concat(F.array(F.col(f"{prefix}n_paragraphs"), F.col(f"{prefix}n_triples")), F.col(f"{prefix}identity"), F.col(f"{prefix}outline"))
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.hex(x))), ",")


def parsed(fingerprint: Column) -> Column:
    return F.transform(F.split(fingerprint, ","), lambda x: F.conv(x, 16, -10).cast("long"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both texts, or with sign -1 of `a` without those of `b`."""

    def add(x: Column, y: Column, i: Column) -> Column:
        low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
        high = lambda v: F.shiftrightunsigned(v, 32)
        one = low(low(x) + sign * low(y))
        two = low(high(x) + sign * high(y))
        return F.when(i < 2 + LANES, low(x + sign * y)).otherwise(F.shiftleft(two, 32).bitwiseOR(one))

    pairs = F.arrays_zip(parsed(a).alias("x"), parsed(b).alias("y"))
    return F.array_join(F.transform(pairs, lambda p, i: F.lower(F.hex(add(p["x"], p["y"], i)))), ",")


def likeness(a: str, b: str) -> Column:
    """Cosine of the outlines of the rows' fingerprints with prefixes `a` and `b`, 0 to 1; 1 if the fingerprints are equal."""

    def signed(prefix: str) -> Column:
        low = lambda x: 2 * x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.col(f"{prefix}n_triples")
        high = lambda x: 2 * F.shiftrightunsigned(x, 32) - F.col(f"{prefix}n_triples")
        outline = F.col(f"{prefix}outline")
        return F.concat(F.transform(outline, low), F.transform(outline, high))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signed(a), signed(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    same = reduce(Column.__and__, [F.col(f"{a}{c}") == F.col(f"{b}{c}") for c in ("identity", "outline", "n_triples", "n_paragraphs")])
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, next_text and (bucket, place), which tell rows apart and by whose bucket the result is partitioned;
    is_own is false for the copies described here, which callers must drop.

    Rows are dealt to `buckets` ranges of doc_id and ordered in each of them. The first rows of a range are copied to the
    end of the range before it (those of the first to the end of the last), so that no row needs another range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id")))) if cuts else F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(1))
    dealt = rows.withColumn("bucket", bucket)
    # One row for each range: bounded by `buckets`.
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.col("bucket").desc()).collect()
    number = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.array_position(number([h.bucket for h in heads]), F.col("bucket").cast("long")).cast("int") - 1
    before = F.get(number([heads[i - 1].bucket for i in range(len(heads))]), at).cast("int")
    own = F.array(F.struct(F.col("bucket"), F.lit(True).alias("is_own")))
    copy = F.array(F.struct(before.alias("bucket"), F.lit(False).alias("is_own")))
    copies = F.when(F.col("doc_id").eqNullSafe(F.get(number([h.top for h in heads]), at)), F.concat(own, copy)).otherwise(own) if heads else own
    spread = dealt.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.*").withColumn("late", ~F.col("is_own"))
    order = Window.partitionBy("bucket").orderBy("late", F.col("doc_id").desc_nulls_last(), "text")
    return spread.select("doc_id", "text", "bucket", "is_own", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, the edited text's digest, both fingerprints, and their likeness to the edited and the next."""
    buckets = max(2, 2 * partitions(docs.sparkSession))
    rows = with_next(docs, buckets)
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.expr("left(coalesce(next_text, ''), char_length(text) div 2)"))
    rows = rows.select("doc_id", "bucket", "place", "is_own", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select("*", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("of"))
    both = both.where(F.col("is_own") | (F.col("of.kind") == 0)).select("doc_id", "bucket", "place", "is_own", "n_chars", "edited_sha256", "of.kind", "of.t")
    prints = fingerprints(both, ["bucket", "place", "kind"], "t", ["doc_id", "is_own", "n_chars", "edited_sha256"])
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    cols = ["n_paragraphs", "n_triples", "identity", "outline"]
    # After a text's own row comes that of its edited form, then the next document's.
    found = prints.select("*", *[F.lead(c, k).over(order).alias(f"{p}{c}") for p, k in (("e_", 1), ("n_", 2)) for c in cols])
    found = found.where(F.col("is_own") & (F.col("kind") == 0))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text().alias("fingerprint"), as_text("e_").alias("edited_fingerprint"), likeness("", "e_").alias("near_edited"), likeness("", "n_").alias("near_next"))
