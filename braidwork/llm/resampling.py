"""Importance resampling towards a target: documents weighted by how their hashed n-grams' odds in the target compare with those
in the corpus, then drawn without replacement by the Gumbel top-k rule. DataFrame expressions only.

A table of positions has a row for each word (posexplode); for orders above one, lead() over a document's positions puts the
following words beside it. Features are hashed into BUCKETS buckets, counted with partial sums, and each bucket's gain joined
back: it is the log odds of the bucket, smoothed by one, in thousandths.

Edge cases: a null or empty text has no words and weight 0; a null id hashes as the empty string and comes last among ties;
rows equal in id and text are one group with a count until the end, so copies of one row never meet in a task, and get
neighbouring ranks; rows of one id with unlike texts are weighed apart; an empty corpus gives an empty result, an empty target
gains as counts of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import written

#: A word, after A-Z have become a-z: fixed values, with the letters that change.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest run of words that is a feature, buckets that features hash to, seed of the draw, words that a drawn document has at
#: least, and how many in a hundred of those are drawn.
ORDERS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
#: Scores of one band share their high bits; bands, not scores, meet in the one task that adds up all before.
BAND = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def features(texts: DataFrame, keys: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """keys, copies, first (true in one row of each text), word (true for a feature of one word), bucket (null in the one row
    of a text without words). `texts` has the keys, which tell its rows apart where orders is above one, copies and text."""
    at = texts.select(*keys, "copies", F.posexplode_outer(words(F.col("text"))).alias("pos", "w1"))
    if orders > 1:
        following = Window.partitionBy(*keys).orderBy("pos")
        at = at.withColumns({f"w{k + 1}": F.lead("w1", k).over(following) for k in range(1, orders)})
        runs = [F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[f"w{k}" for k in range(1, n + 1)])) for n in range(1, orders + 1)]
        at = at.select(*keys, "copies", "pos", F.posexplode(F.array(*runs)).alias("order", "feature")).where("feature is not null or order = 0")
    else:
        at = at.withColumn("order", F.lit(0)).withColumn("feature", F.col("w1"))
    bucket = (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int")
    return at.select(*keys, "copies", ((F.coalesce("pos", F.lit(0)) == 0) & (F.col("order") == 0)).alias("first"), ((F.col("order") == 0) & F.col("feature").isNotNull()).alias("word"), bucket.alias("bucket"))


def _texts(docs: DataFrame, orders: int, *ids: str) -> DataFrame:
    """The ids, a key of two hashes of the text, copies and text: with orders above one each pair of id and text once."""
    own = docs.select(*ids, "text", F.lit(1).cast("long").alias("copies"))
    if orders > 1:
        own = own.groupBy(*ids, "text").agg(F.sum("copies").alias("copies"))
    return own.select(*ids, F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(SEED), "text").alias("k2"), "copies", "text")


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: one row for each bucket that a feature of `docs` falls into, so at most `buckets`."""

    def counts(texts: DataFrame, name: str) -> DataFrame:
        return features(_texts(texts, orders), ["k1", "k2"], orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias(name))

    both = counts(docs, "s").join(counts(target, "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    every = Window.partitionBy()  # over `buckets` rows at most
    odds = (F.col("t") + 1) * (F.sum("s").over(every) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(every) + buckets))
    return both.select("bucket", "s", F.floor(1000 * F.log(odds)).alias("gain")).where("s > 0").drop("s")


def scored(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, copies, n_words, n_features, weight, score: a row for each id and text, which stands `copies` times in `docs`.

    The gains have at most `buckets` rows, which bounds what is broadcast; sums of a text are made where its words are.
    """
    keys = ["doc_id", "k1", "k2"]
    found = features(_texts(docs, orders, "doc_id"), keys, orders, buckets)
    once = found.join(F.broadcast(gains(docs, target, orders, buckets)), "bucket", "left").groupBy(*keys).agg(
        F.sum(F.when(F.col("first"), F.col("copies"))).alias("copies"),
        F.coalesce(F.sum(F.when(F.col("word"), F.col("copies"))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("copies"))), F.lit(0)).alias("n"),
        F.sum(F.col("gain") * F.col("copies")).alias("total"),
    )
    weight = F.when(F.col("n") > 0, F.floor(F.col("total") / F.col("n"))).otherwise(F.lit(0)).cast("long")
    own = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    chance = F.floor(-1000 * F.log(-F.log((own + 0.5) / 4294967296.0))).cast("long")
    each = lambda c: F.expr(f"{c} div copies")
    return once.select("doc_id", "copies", each("words").alias("n_words"), each("n").alias("n_features"), weight.alias("weight"), (weight + chance).alias("score"))


def _standing(eligible: DataFrame, percent: int) -> DataFrame:
    """score, before (rows with a higher one), quota. Scores are integers, and logs of doubles: some 10^5 values at most."""
    counts = eligible.groupBy("score").agg(F.sum("copies").alias("n")).withColumn("band", F.shiftright("score", BAND))
    above = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.groupBy("band").agg(F.sum("n").alias("n")).select("band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("bands"), F.floor(percent * F.sum("n").over(Window.partitionBy()) / 100).alias("quota"))
    inside = Window.partitionBy("band").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bands, "band").select("score", (F.col("bands") + F.col("inside")).alias("before"), "quota")


def resampled(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of `docs`; rank is null where it is not drawn.

    Of the rows with `least` words or more, `percent` in a hundred (rounded down) with the highest scores are drawn, ties to
    smaller ids. Only scores that reach the quota are put in order, each in a task of its own.
    """
    rows = written(scored(docs, target, orders, buckets, seed), "resampled")
    standing = F.broadcast(_standing(rows.where(F.col("n_words") >= least), percent))
    judged = rows.join(standing, "score", "left").withColumn("open", F.coalesce((F.col("n_words") >= least) & (F.col("before") < F.col("quota")), F.lit(False)))
    earlier = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    drawn = judged.where("open").withColumn("start", F.col("before") + F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    rest = judged.where("not open").withColumn("start", F.lit(None).cast("long"))
    place = F.col("start") + F.col("copy")
    every = drawn.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select("doc_id", "n_features", "weight", "score", F.when(place <= F.col("quota"), place).alias("rank"))
