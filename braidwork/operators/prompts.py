"""Prompt sets: deduplication in order, seeded fills, exclusion, shards, manifests, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.ranges import ranges


def first_occurrences(rows: DataFrame, key: str, order: str, first: list[str], most: list[str]) -> DataFrame:
    """One row per key: its first place, columns `first` from there, and the greatest of columns `most` over all."""
    aggs = [F.min_by(c, order).alias(c) for c in first] + [F.max(c).alias(c) for c in most]
    return rows.groupBy(key).agg(F.min(order).alias(order), *aggs)


def seeded_fill(seeds: DataFrame, pool: DataFrame, key: str, order: str, label: str, n: int) -> DataFrame:
    """The seeds, all of them, and the first rows of the pool by order with a label and a key not met before, to n in all.
    A row without label does not count as having met its key."""
    met = seeds.where(F.col(label).isNotNull()).select(key).distinct()
    fresh = pool.where(F.col(label).isNotNull()).join(met, key, "left_anti")
    fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    room = max(0, n - seeds.count())
    more = fresh.orderBy(order).limit(room)
    return seeds.withColumn("src", F.lit(0)).unionByName(more.withColumn("src", F.lit(1)), allowMissingColumns=True)


def shuffled(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    """A seeded order that does not depend on partitions, as a column `shuffle`."""
    return rows.withColumn("shuffle", F.xxhash64(F.lit(seed), key))


def places(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds place, from 0, in the order of columns that tell rows apart; and the number of rows."""
    index = ranges(rows, order)
    return index.numbered(), index.total


def round_robin(rows: DataFrame, place: Column, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))


def contiguous(rows: DataFrame, place: Column, total: int, shards: int) -> DataFrame:
    """Shards of ceil(total / shards) consecutive places."""
    return rows.withColumn("shard", F.floor(place / F.lit(max(1, -(-total // shards)))).cast("int"))


def manifest_verdicts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, verdict) from files (path, sha256) and a manifest of the same columns."""
    known = manifest.select("path", F.col("sha256").alias("_want"))
    verdict = F.when(F.col("_want").isNull(), "NO MANIFEST ENTRY").when(F.col("sha256") == F.col("_want"), "MATCH").otherwise("MISMATCH")
    return files.join(known, "path", "left").select("path", verdict.alias("verdict"))


def catalogue_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that one side lacks or whose fields differ, nulls being equal to nulls: (key, difference)."""
    left = a.select(F.col(key), F.struct(*fields).alias("_a"))
    right = b.select(F.col(key), F.struct(*fields).alias("_b"))
    both = left.join(right, key, "full")
    kind = F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(key, kind.alias("difference")).where("difference is not null")


def last_before(events: DataFrame, probes: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """As-of join: for each probe the last event of its key at an earlier place, by one union and one window instead of an
    inequality join. Probes have `at` too; ties do not count as earlier."""
    one = events.select(*key, at, F.col(value).alias("_v"), F.lit(1).alias("_kind"))
    two = probes.select(*key, at, F.lit(None).cast(dict(events.dtypes)[value]).alias("_v"), F.lit(0).alias("_kind"))
    order = Window.partitionBy(*key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = one.unionByName(two).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return seen.where("_kind = 0").select(*key, at, value)


def longest_prefix(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, prefix): the longest cached prefix of each text. Texts meet prefixes by an equality join on the prefix, for the
    lengths that the cache has (one row of as many numbers as the longest prefix has at most), so nothing is a nested loop."""
    sizes = cached.select(F.length("prefix").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    rows = texts.crossJoin(F.broadcast(sizes))
    cut = rows.select("id", F.explode(F.filter("sizes", lambda n: n <= F.length("text"))).alias("n"), "text")
    cut = cut.select("id", F.expr("left(text, n)").alias("prefix"))
    return cut.join(cached.select("prefix").distinct(), "prefix").groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def messages(prompt: Column) -> Column:
    """A text as a conversation of one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def only_user(prompt: Column) -> Column:
    """The one user message's content; another number of them is an error."""
    users = F.filter(prompt, lambda m: m["role"] == "user")
    return F.when(F.size(users) == 1, F.get(users, 0)["content"]).otherwise(F.raise_error(F.lit("not exactly one user message")))


def record(domain: str, index: Column, source: Column, prompt: Column, label: Column) -> Column:
    return F.struct(messages(prompt).alias("prompt"), label.alias("label"), F.lit(domain).alias("domain"), F.struct(F.lit(domain).alias("domain"), source.alias("data_source"), index.alias("src_index")).alias("metadata"))


def teacher_of(metadata: Column, keys: tuple[str, ...], default: str) -> Column:
    """The value of the first key that is present, even if it is null; the default if none is."""
    out = F.lit(default)
    for k in reversed(keys):
        out = F.when(F.map_contains_key(metadata, k), F.try_element_at(metadata, F.lit(k))).otherwise(out)
    return out


def role_mask(turns: Column, role: str = "assistant") -> Column:
    """One 0 or 1 per word of a conversation's turns, in order: 1 in turns of the role."""
    return F.flatten(F.transform(turns, lambda t: F.transform(F.filter(F.split(t["text"], r"\s+"), lambda w: w != ""), lambda w: (t["role"] == role).cast("int"))))


def covered(groups: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """Groups with whether the bank has their key. The bank may be large: the join is left to Spark."""
    return groups.join(bank.select(key, F.lit(True).alias("covered")).distinct(), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def chained(rows: DataFrame, parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows with the columns of each part by key; a row that a part lacks is an error."""
    for i, part in enumerate(parts):
        mark = f"_in{i}"
        fail = F.raise_error(F.concat_ws(" ", F.lit(f"part {i} lacks"), *[F.col(k).cast("string") for k in key])).cast("boolean")
        rows = rows.join(part.withColumn(mark, F.lit(True)), key, "left").where(F.coalesce(F.col(mark), fail)).drop(mark)
    return rows


def positional(pool: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """Rows of the pool by listed places, in the list's order as `place`; repeated ones as often."""
    ids = pool.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"place long, {index} long")
    return pool.join(F.broadcast(ids), index)  # the list is part of the program


def frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Keys that occur `least` times or more, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def short_prompts(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Rows whose prompt has at most `most` words; a null prompt, which cannot be measured, goes."""
    return rows.where(F.regexp_count(F.col(text), F.lit(r"\S+")) <= most)


def of_domain(rows: DataFrame, domain: Column, wanted: str, index: str) -> DataFrame:
    """Rows of one domain, with their place in the whole file kept as src_index."""
    return rows.where(F.coalesce(domain, F.lit("")) == wanted).withColumn("src_index", F.col(index))


def pass_band(rates: DataFrame, lo: float = 0.125, hi: float = 0.875) -> DataFrame:
    """Prompts that are neither hopeless nor solved."""
    return rates.where(F.col("pass_rate").between(lo, hi))


def unrepeated(rows: DataFrame, key: Column, order: str, most: int) -> DataFrame:
    """Of generated rows, the first `most` that repeat no earlier one; at most 50 times as many are looked at."""
    looked = rows.orderBy(order).limit(50 * most).withColumn("_k", key)
    first = looked.groupBy("_k").agg(F.min(order).alias("_o"))
    kept = looked.join(first, "_k").where(F.col(order) == F.col("_o"))
    return kept.orderBy(order).limit(most).drop("_k", "_o")


def overridden(metadata: Column, kind: Column, overrides: Column) -> Column:
    """A string map with rm_type put in, over which the overrides win."""
    entries = F.concat(F.map_entries(F.coalesce(metadata, F.expr("map()").cast("map<string,string>"))), F.map_entries(F.create_map(F.lit("rm_type"), kind)), F.map_entries(overrides))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def arguments(given: Column, count: Column) -> Column:
    """Keyword maps without null values, as many as there are instructions: more are cut, missing ones are empty."""
    kind = "array<map<string,string>>"
    clean = F.transform(F.coalesce(given, F.array().cast(kind)), lambda m: F.map_filter(F.coalesce(m, F.expr("map()").cast("map<string,string>")), lambda k, v: v.isNotNull()))
    empty = F.array_repeat(F.expr("map()").cast("map<string,string>"), F.greatest(count - F.size(clean), F.lit(0)))
    return F.slice(F.concat(clean, empty), 1, count)


def resolved(*layers: dict) -> dict:
    """Settings of several layers, the first that has a value (not None) wins; keys that the last does not know are an error."""
    known = layers[-1]
    if unknown := sorted({k for layer in layers for k in layer} - set(known)):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return {k: next((layer[k] for layer in layers if layer.get(k) is not None), None) for k in known}


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of both, of the left or of the right only."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    part = lambda df, name: df.withColumn("side", F.lit(name))
    return part(one.intersect(two), "both").unionByName(part(one.exceptAll(two), "left")).unionByName(part(two.exceptAll(one), "right"))


def student_set(pools: dict[str, DataFrame], per_domain: int, seed: int) -> DataFrame:
    """(key, domain, src_index): of each domain's pool (key, src_index, label) the first `per_domain` labelled keys in a
    seeded order, each key once, and no key of an earlier domain."""
    out = None
    for domain, pool in pools.items():
        rows = pool.where("label is not null").groupBy("key").agg(F.min("src_index").alias("src_index"))
        if out is not None:
            rows = rows.join(out.select("key"), "key", "left_anti")
        picked = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(per_domain).withColumn("domain", F.lit(domain))
        out = picked if out is None else out.unionByName(picked)
    return out.select("key", "domain", "src_index")


def catalogue(rows: DataFrame, prompt: Column, answer: Column) -> DataFrame:
    """(id, input_sha256, visible, answer): a benchmark's rows, named by the digest of what a model is shown."""
    return rows.select(F.col("id").cast("string").alias("id"), F.sha2(prompt, 256).alias("input_sha256"), prompt.alias("visible"), answer.alias("answer"))
