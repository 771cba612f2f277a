"""What op8_near moves: texts once, members of a small bucket once; classes by themselves without any of it."""

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import near, queries


def test_classes_need_no_links(spark, tmp_path, monkeypatch):
    rows = [(4, "a b"), (2, "a b"), (9, "A b"), (7, None), (5, ""), (3, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(r.doc_id, r.class_id) for r in near.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for name in ("grouped", "_sketched"):
        monkeypatch.setattr(near, name, None)
    got = {tuple(r) for r in queries.near_classes(spark, str(tmp_path)).collect()}
    assert got == want == {(4, 2), (2, 2), (9, 9), (7, 5), (5, 5), (3, 3)}


def _moves(plan: str) -> int:
    """Exchanges that rows go through after the first Python step of a plan."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    depth, found = lines[at].index("MapInArrow"), 0
    for x in reversed(lines[:at]):
        here = next((i for i, c in enumerate(x) if c.isalpha()), depth)
        if here < depth:
            depth, found = here, found + ("Exchange" in x)
    return found


def test_texts_are_moved_once(spark, monkeypatch):
    """Also where the wanted texts are too many to be sent to every task; a row with the id of another text's class is not its text."""
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (2, "one two"), (3, "four"), (3, "four")], "doc_id long, text string")
    nodes = docs.select("doc_id", near.digest().alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("class_id")).withColumn("node", F.col("class_id"))
    made, bucketed = [], near.bucketed
    monkeypatch.setattr(near, "bucketed", lambda df, *a: made.append(df) or bucketed(df, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = near._texts(docs, nodes, nodes.select("node"), False)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stays = made[0].repartition(n, "node").dropDuplicates(["node"])
        assert _moves(stays._jdf.queryExecution().executedPlan().toString()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = lambda t: (near.words(t) >> np.uint64(32)).astype(np.uint32).tobytes()
    assert {r.node: bytes(r.words) for r in texts.collect()} == {1: words("one two"), 2: words("two three"), 3: words("four")}


def test_members_of_a_small_bucket_are_moved_once(spark, monkeypatch):
    rows = [(7, n, 40, 3) for n in range(1, 7)] + [(8, n, 40, 5) for n in (1, 4, 6)]
    opened = spark.createDataFrame(rows, "bucket long, node long, size int, place int")
    roots = spark.createDataFrame([(2, 1), (1, 1), (3, 1), (5, 4), (4, 4)], "node long, root long")
    same = near.gauge(np.arange(40, dtype=np.uint64)).tobytes()
    hashes = lambda n: np.arange(near.SKETCHES, dtype=np.uint32).tobytes() + bytes(range(near.SKETCHES))
    gauges = spark.createDataFrame([(n, bytearray(same), bytearray(hashes(n))) for n in range(1, 7)], "node long, gauge binary, sketch binary")
    dealt, run = [], type(opened).mapInArrow
    monkeypatch.setattr(type(opened), "mapInArrow", lambda df, *a: dealt.append(df) or run(df, *a))
    root = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    apart = {(a, b) for a in root for b in root if a < b and root[a] != root[b]}
    near_ones = {tuple(r) for r in near._unjoined(opened, roots, gauges.select("node", "gauge")).collect()}
    assert dealt[0].count() == len(rows)
    assert near_ones <= apart and {x for p in near_ones for x in p} == set(root)
    # All share bucket 7's order and 8's; the first order that two sketches have tells of the pair.
    every = near._unjoined(opened.withColumn("place", F.lit(0)), roots, gauges)
    assert {tuple(r) for r in every.collect()} == apart and dealt[1].count() == len(rows)
