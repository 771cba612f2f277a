import random
import time

import pytest
from pyspark.sql import functions as F

from braidwork.sources import readers, sinks
from braidwork.streaming import resume, state


def test_jsonl_lenient_and_strict(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "x", "n": 1}\n\n{broken\n')
    good, bad = readers.jsonl(spark, str(path), "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("x", 1)] and bad.count() == 1
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, str(path), "id string, n int").collect()


def test_slices(spark):
    assert readers.parse_slice("a.jsonl@[2:5]") == ("a.jsonl", 2, 5)
    with pytest.raises(ValueError):
        readers.parse_slice("a@[-1:3]")
    assert [r.id for r in readers.sliced(spark.range(9), "id", 2, 5).collect()] == [2, 3, 4]


def test_records_layouts(spark, tmp_path):
    line = '{"id": "1", "input_sha256": "h", "n": 2, "correct": "10", "mean_tokens": 3.5, "cap_hits": 0}\n'
    for p in ("scores/s1/cap8/m1.jsonl", "r/m2/s2/cap16/scores.jsonl"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_text(line)
    a = readers.records(spark, str(tmp_path)).first()
    b = readers.records(spark, str(tmp_path / "r")).first()
    assert (a.suite, a.cap, a.model) == ("s1", 8, "m1") and (b.suite, b.cap, b.model) == ("s2", 16, "m2")


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    row = sinks.sealed(df, str(tmp_path / "t")).first()
    assert row.rows == 5 and row.digest == sinks.sealed(df.repartition(3), str(tmp_path / "u")).first().digest
    assert sinks.markdown(df.limit(1)).splitlines()[-1] == "| 0 |"
    assert {r.name: r.value for r in sinks.metrics(df.agg(F.sum("id").alias("s")), 3).collect()} == {"s": 10.0}


def test_streamed_frozen_multipliers_equal_the_batch(spark, tmp_path):
    rows = [(1, "a", 1.0, False), (2, "a", 2.0, True), (3, "a", 3.0, True)]
    df = spark.createDataFrame(rows, "step long, domain string, multiplier double, measurable boolean")
    for i in range(3):
        df.where(F.col("step") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = resume.frozen_multipliers(stream).writeStream.format("memory").queryName("frozen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.step, r.applied) for r in spark.table("frozen").collect()) == [(1, 1.0), (2, 2.0), (3, 2.0)]


def test_records_of_no_layout(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.records(spark, str(tmp_path))


def test_json_arrays_and_documents(spark, tmp_path):
    for start, ids in ((0, [5, 3]), (2, [9]), (10, [1, 7, 2])):
        (tmp_path / f"chunk_{start}.json").write_text("[" + ",\n ".join(f'{{"id": {i}}}' for i in ids) + "]")
    rows = readers.json_arrays(spark, str(tmp_path / "chunk_*.json"), "id long").orderBy("start", "place").collect()
    assert [(r.start, r.id) for r in rows] == [(0, 5), (0, 3), (2, 9), (10, 1), (10, 7), (10, 2)]
    (tmp_path / "doc.json").write_text('{"size": "2B",\n "contrasts": [{"a": "x", "delta": 1.5},\n {"a": "y", "delta": -1}]}')
    assert [tuple(r) for r in readers.json_document(spark, str(tmp_path / "doc.json"), "size string, contrasts array<struct<a:string,delta:double>>", "contrasts").collect()] == [("x", 1.5), ("y", -1.0)]


def test_slices_without_an_end(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "i long").repartition(6)
    assert sorted(r.i for r in readers.sliced(df, "i", 45, None).collect()) == [45, 46, 47, 48, 49]
    assert sorted(r.i for r in readers.sliced(df, "i", 3, 6).collect()) == [3, 4, 5]


def _streamed(spark, tmp_path, batches, schema, operator, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(0.01)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_filter_releases_after_its_budget(spark, tmp_path):
    batches = [[("r", 1, True), ("r", 2, False)], [("r", 3, False), ("r", 4, False)]]
    rows = _streamed(spark, tmp_path, batches, "run string, group_index long, keep boolean", lambda s: state.bounded_filter(s, 3), "bounded")
    assert sorted((r.group_index, r.accept, r.released) for r in rows) == [(1, True, False), (2, False, False), (3, False, False), (4, True, True)]


def test_streamed_filter_begins_anew_at_its_target(spark, tmp_path):
    rng, target, budget = random.Random(6), 3, 5
    groups = [(i, rng.random() < 0.35) for i in range(40)]
    want, seen, kept = [], 0, 0
    for i, keep in groups:
        if kept >= target:
            seen = kept = 0
        seen += 1
        accept = keep or seen > budget
        kept += accept
        want.append((i, accept, seen > budget, kept))
    batches = [[("r", i, k) for i, k in groups[at : at + 9]] for at in range(0, 40, 9)]
    rows = _streamed(spark, tmp_path, batches, "run string, group_index long, keep boolean", lambda s: state.bounded_filter(s, budget, target), "anew")
    assert sorted((r.group_index, r.accept, r.released, r.kept) for r in rows) == want


def test_keys_are_seen_once(spark, tmp_path):
    rows = _streamed(spark, tmp_path, [[("a",), ("b",)], [("b",), ("c",), ("a",)]], "key string", lambda s: state.unseen(s, "key"), "once")
    assert sorted(r.key for r in rows) == ["a", "b", "c"]


def test_streamed_buffer_keeps_partial_samples(spark, tmp_path):
    batches = [[("r", 1, 0, "aborted"), ("r", 1, 1, "completed")], [("r", 2, 0, "completed"), ("r", 2, 2, "truncated")]]
    rows = _streamed(spark, tmp_path, batches, "run string, step long, index long, status string", resume.partial_buffer, "partial")
    assert sorted((r["index"], r.first_step, r.step, r.off_policy) for r in rows) == [(0, 1, 2, True), (1, 1, 1, False), (2, 2, 2, False)]
