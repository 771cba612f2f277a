"""Mixing sources to target weights by a low-discrepancy schedule, as DataFrame expressions only.

Time runs in slots t = 0, 1, ..., one for each BLOCK words. Slot t belongs to the source into whose stretch of the cumulative
weights the fractional part of (t + 1/2) times the golden ratio falls, so that any run of slots is mixed nearly to weight;
a source whose stretch no slot meets gets one at the end. The stream of a source is its documents in the order of a hash,
begun anew at its end; as many equal blocks as the source has slots (of one word more or less) cut its target, rounded to whole
words, from the stream's beginning on, and the k-th slot takes the k-th block. A mix may end after any number of slots: what is
taken of a document follows from how many of its source's slots there are by then, and its place in the mix is the slot of the
block that holds its first word. After all slots every source has given just its target.

Edge cases: a null text has no words, a null source is a source (the last); documents without words are never taken;
repeated rows count each on its own; ties in the order of the hash are broken by id and text; if no source has words, all
targets are 0; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import fresh, partitions, running, words_in, written

#: Words for a slot; the seed of the order of documents.
BLOCK, SEED = 64, 11
#: No document is taken more often than this.
TIMES = 3
#: Fractional parts of the golden ratio and of 2^20 times it; two factors keep the points exact for large slots.
GOLDEN, GOLDEN_20 = 0.6180339887498949, ((math.isqrt(5 << 200) + (1 << 100) << 19) % (1 << 100)) / (1 << 100)
#: Slots that one task ranks; cells of the grid on which slots meet sources.
SPAN, CELLS = 65_536, 4096


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, from one row per source (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target is the lesser of TIMES the size and weight times
    a level at which all targets together give all sizes: sources are filled up in the order of size over weight, and
    the level is what is left when the filled ones have had theirs, over the weight of the others.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("weight", F.pmod(place - 1, F.lit(3)) + 1).withColumn("cap", F.lit(TIMES) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    until = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(until), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(until), F.lit(0))
    w = w.withColumn("level", left / rest).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # The first source that is not filled sets the level for itself and all after it.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def schedule(goals: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """slot, source, rank (from 0): the source of each of total/block slots and its place among that source's slots.

    Ranks come in two steps, within spans of slots and over spans, so that no source's slots meet in one task.
    """
    spark = goals.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    share = goals.withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy()))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    # Where a source's stretch meets no slot at all its cells are few; all sources together have CELLS and one each.
    stretch = share.where(F.col("hi") > F.col("lo")).select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    n = -(-total // block)
    slots = spark.range(0, n, numPartitions=max(1, min(partitions(spark), n // SPAN + 1))).withColumnRenamed("id", "slot")
    low, high = F.col("slot") % (1 << 20), F.floor(F.col("slot") / (1 << 20))
    point = F.pmod((low + 0.5) * F.lit(GOLDEN) + high * F.lit(GOLDEN_20), F.lit(1.0))
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS)).withColumn("span", F.floor(F.col("slot") / SPAN))
    last = F.col("hi") >= 1.0 - 1e-12
    dealt = slots.join(stretch, "cell").where((F.col("point") >= F.col("lo")) & ((F.col("point") < F.col("hi")) | last)).select("slot", "span", "source")
    # Each span's first rank for a source.
    spans = dealt.groupBy("source", "span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("_s"), F.col("span").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("source", "span").orderBy("slot")) - 1)
    met = ranked.join(spans, ranked.source.eqNullSafe(spans._s) & (ranked.span == spans._p))
    return met.select("slot", "source", (F.col("_in") + F.col("_before")).alias("rank"))


def streams(goals: DataFrame, plan: DataFrame, total: int, block: int = BLOCK, until: int | None = None) -> DataFrame:
    """source, source_size, target, words (the rounded target), slots, and used: how many of the source's slots are among the
    first `until` (None: all). A source that no slot meets has one after all others."""
    end = -(-total // block)
    early = F.lit(True) if until is None else F.col("slot") < until
    many = plan.groupBy("source").agg(F.count(F.lit(1)).alias("slots"), F.count_if(early).alias("used"))
    sizes = goals.select(F.col("source").alias("_g"), "source_size", "target", F.floor(F.col("target") + 0.5).alias("words"))
    known = sizes.join(many, F.col("_g").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("_g", "source")
    last = int(until is None or until > end)
    return known.select("source", "source_size", "target", "words", F.coalesce("slots", F.lit(1)).alias("slots"), F.coalesce("used", F.lit(last)).alias("used"))


def _wide(c: Column) -> Column:
    """Products of words and slots leave 64 bits on large tables."""
    return c.cast("decimal(19,0)")


def _edge(rank: Column) -> Column:
    """The word at which a source's block of a rank begins: its target is cut into as many equal blocks as it has slots."""
    return F.call_function("div", _wide(rank) * _wide(F.col("words")), _wide(F.col("slots"))).cast("long")


def _rank(word: Column) -> Column:
    """The rank of the block that holds a word: the last whose beginning is not after it."""
    return (F.call_function("div", _wide(word + 1) * _wide(F.col("slots")) + _wide(F.col("words")) - 1, _wide(F.col("words"))) - 1).cast("long")


def placed(docs: DataFrame, seed: int = SEED, block: int = BLOCK, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents and the schedule that they meet: (doc_id, source, mix, size, first, taken and the columns of streams()), and
    (slot, source, rank). first is the document's place in its source's stream, null without words; taken are its words among
    those of the source's blocks that are used, repeats counted as often as the stream comes round."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", mix_hash(seed).alias("mix"), words_in(F.col("text")).alias("size"))
    rows = written(rows, "mix-sizes")
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    plan = written(schedule(goals, total, block), "mix-slots")
    told = written(streams(goals, plan, total, block, until), "mix-streams")
    end = -(-total // block)
    extra = told.join(plan.select(F.col("source").alias("_s")).distinct(), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    slots = plan.select("slot", "source", F.col("rank").cast("long").alias("rank")).unionByName(extra.select(F.lit(end).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("rank")))
    at = running(rows.where("size > 0"), ["source"], ["mix", "doc_id"], "size", "first", max(partitions(spark), count // 50_000))
    both = at.unionByName(rows.where("size = 0").withColumn("first", F.lit(None).cast("long")))
    told = told.withColumnRenamed("source", "_s")
    met = both.join(told, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_end", _edge(F.col("used")))
    over = F.col("_end") - F.expr("_end div greatest(source_size, 1)") * F.col("source_size") - F.col("first")
    taken = F.expr("_end div greatest(source_size, 1)") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), over))
    return met.withColumn("taken", F.when(F.col("first").isNull(), F.lit(0)).otherwise(taken).cast("long")).drop("_end"), slots


def _at_slot(rows: DataFrame, slots: DataFrame, word: Column, out: str) -> DataFrame:
    """Adds the slot of the block that holds `word`; null where that is null."""
    ranked = rows.withColumn("_rank", _rank(word))
    named = slots.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), F.col("slot").alias(out))
    return ranked.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_rank") == F.col("_r")), "left").drop("_s", "_r", "_rank")


def takes(docs: DataFrame, seed: int = SEED, block: int = BLOCK, until: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, mix (a hash of id and text), size, source_size, target, taken: the number of its
    words that the schedule takes in its first `until` slots (None: all), repeats counted, and first_slot: the slot that takes
    its first word, null where none does."""
    rows, slots = placed(docs, seed, block, until)
    met = _at_slot(rows, slots, F.when(F.col("taken") > 0, F.col("first")), "first_slot")
    return met.select("doc_id", "source", "mix", "size", "source_size", "target", "taken", "first_slot")


def report(docs: DataFrame) -> DataFrame:
    return takes(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mix_hash(seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK, until: int | None = None) -> DataFrame:
    """The rows of `docs` as often as the first `until` slots (None: all) take them, with their columns, in the order of the
    slots that their copies begin in. Of a source only the document at which the schedule ends is taken in part; it counts as
    whole if half of it or more is."""
    found, slots = placed(docs, seed, block, until)
    copies = F.round(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    mix, place, slot = fresh(docs, "_mix"), fresh(docs, "_place"), fresh(docs, "_slot")
    key = Window.partitionBy("doc_id", "source", "mix").orderBy("first")
    plan = found.where("taken > 0").withColumn("_copies", copies).where("_copies > 0").withColumn("_n", F.row_number().over(key))
    each = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    each = _at_slot(each, slots, F.col("first") + F.col("_copy") * F.col("source_size"), "_slot")
    # A document's copies in one row, so that its text is joined once.
    listed = each.groupBy("doc_id", "source", "mix", "_n").agg(F.collect_list("_slot").alias("_slots"))
    name = fresh(docs, "_plan")
    told = listed.select(F.struct(F.col("doc_id").alias("_i"), F.col("source").alias("_t"), F.col("mix").alias("_m"), "_n", "_slots").alias(name))
    rows = docs.withColumn(mix, mix_hash(seed))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", "source", mix).orderBy(mix)))
    pairs = (("doc_id", "_i"), ("source", "_t"), (mix, "_m"), (place, "_n"))
    on = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(f"{name}.{b}")) for a, b in pairs])
    kept = rows.join(told, on).select(*docs.columns, F.explode(F.col(f"{name}._slots")).alias(slot))
    return kept.orderBy(slot).select(*docs.columns)
