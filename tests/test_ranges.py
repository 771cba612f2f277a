"""Places of tables in many partitions, pages through epochs, and the stream of steps."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import prompts, ranges, rollouts
from braidwork.plans import more, queries
from braidwork.sources import readers
from braidwork.streaming import epochs

ROWS = 1_000_003


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def million(spark):
    """Keys 0, 3, 6, ... in another order, with text beside them, in 8 partitions."""
    return spark.range(ROWS, numPartitions=8).select(((F.col("id") * 7919) % ROWS * 3).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("_range"))


def test_places_of_a_million_rows(coalesced):
    placed, n = prompts.places(million(coalesced), ["k"])
    assert n == ROWS and placed.columns == ["k", "_range", "place"]
    assert placed.where("place * 3 <> k or place is null").count() == 0 and placed.select("place").distinct().count() == ROWS
    assert prompts.round_robin(placed, F.col("place"), 8).groupBy("shard").count().count() == 8


def test_slices_of_a_million_rows(coalesced):
    rows = million(coalesced)
    assert sorted(r.k for r in readers.sliced(rows, "k", 1_000_000, 1_000_010).collect()) == [3 * i for i in range(1_000_000, ROWS)]
    assert readers.sliced(rows, "k", 100_000, 600_000).agg(F.count("k"), F.min("k"), F.max("k"), F.countDistinct("k")).first() == (500_000, 300_000, 1_799_997, 500_000)
    assert readers.sliced(rows, "k", ROWS, None).count() == 0


def test_a_slice_reads_its_ranges_only(coalesced):
    index = ranges.ranges(million(coalesced), ["k"], 16)
    at = index.starts[-1]
    found = index.between(at + 5, at + 9)
    assert found.count() == 4 and f"isnotnull({index.range_}" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    index.forget()


@pytest.mark.parametrize("name", ["shard_round_robin", "sample_numbers"])
def test_queries_on_dealt_input(coalesced, name, tmp_path):
    sf = "/root/testdata/sf0.01"
    coalesced.read.parquet(f"{sf}/orders.parquet").repartition(8).write.parquet(str(tmp_path / "orders.parquet"))
    assert name in {**queries.QUERIES} and more
    want, got = (queries.QUERIES[name](coalesced, d) for d in (sf, str(tmp_path)))
    assert rollouts.same_sets(want, got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101, 4096, 12_345])
def test_permutations(n):
    orders = [ranges.permuted(np.arange(n), n, 5, np.full(n, e)) for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 50:
        assert len({tuple(o) for o in orders}) == 3 and abs(np.corrcoef(np.arange(n), orders[0])[0, 1]) < 0.3


def test_forgotten_tables_are_gone(spark):
    index = ranges.ranges(spark.range(10), ["id"])
    files = index.table.inputFiles()
    index.forget()
    assert files and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)


def test_pages_go_through_epochs(spark):
    rows = spark.range(50).select((F.col("id") * 2).alias("key")).repartition(5)
    index = ranges.ranges(rows, ["key"])
    whole = ranges.page(index, 3, 0, 120).orderBy("step").collect()
    assert [r.step for r in whole] == list(range(120)) and [r.epoch for r in whole] == [i // 50 for i in range(120)]
    for epoch in (0, 1):
        assert sorted(r.key for r in whole if r.epoch == epoch) == [2 * i for i in range(50)]
    assert [r.key for r in whole[:50]] != [r.key for r in whole[50:100]]
    part = ranges.page(index, 3, 45, 30).orderBy("step").collect()
    assert part == whole[45:75]
    assert sorted(rollouts.page(rows, "key", 3, 45, 30).collect(), key=lambda r: r.step) == [r.__class__(key=r.key, step=r.step, epoch=r.epoch, slot=r.slot) for r in part]
    assert ranges.page(ranges.ranges(rows.limit(0), ["key"]), 3, 0, 5).count() == 0


def test_a_page_far_along_sorts_nothing(spark):
    index = ranges.ranges(million(spark), ["k"])
    page = ranges.page(index, 1, 10**12, 64)
    assert page.count() == 64 and "Window" not in page._jdf.queryExecution().toString()


def test_a_stream_of_epochs_goes_on_after_a_restart(spark, tmp_path):
    index = ranges.ranges(spark.range(40).withColumnRenamed("id", "key"), ["key"])
    got: list = []

    def run(until):
        stream = epochs.steps(spark, index.total, batch=15, seed=9, until=until)
        query = stream.writeStream.foreachBatch(lambda df, i: got.append((i, sorted((r.step, r.epoch, r.slot, r.key) for r in epochs.samples(index, df).collect())))).option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
        query.stop()

    run(33)
    before = len(got)
    run(101)
    rows = [r for _, batch in got for r in batch]
    assert before == 3 and [r[0] for r in rows] == list(range(101)) and [b[0] for b in got] == sorted({b[0] for b in got})
    page = ranges.page(index, 9, 0, 101).collect()
    assert sorted((r.step, r.epoch, r.slot, r.key) for r in page) == rows


def test_streams_without_rows_are_refused(spark):
    with pytest.raises(ValueError):
        epochs.steps(spark, 0, batch=5, seed=1)
