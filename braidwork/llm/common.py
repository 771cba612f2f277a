"""Helpers that the operators share: inputs, materialised tables, and ranks and running sums without one-task windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="braidwork-")
        shared_dir.own = folder
    return folder


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cuts the lineage: writes `df` as a Parquet table to the shared folder, by the session's codec or another, and reads it
    again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As written(), one row of each `key`, dealt by it into as many buckets as there are partitions: joins by `key` do not
    move it again."""
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", partitions(spark)
    df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).format("parquet").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def forget(df: DataFrame) -> None:
    """Deletes the table that `df`, from written() or bucketed() and with columns chosen at most, reads; nothing else may
    need it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].replace("_", "").isalnum():
            spark.sql(f"drop table if exists {path.rpartition('/')[2]}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` has not, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_in(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], value: str | None, out: str, chunks: int) -> DataFrame:
    """Adds `out`: for each row the sum of `value` (with None: the count) over the rows of its keys before it.

    The order within a key is (chunk, *order), where chunk is a hash of the `order` columns modulo `chunks`; so a key
    with a third of all rows is dealt to `chunks` tasks, and only one row per key and chunk meets in the second step.
    The frame is read twice: pass something that is cheap to recompute or written. Rows equal in keys and order columns
    get distinct, interchangeable places.
    """
    one = F.col(value) if value else F.lit(1)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sums = dealt.groupBy(*keys, "_chunk").agg(F.sum(one.cast("long")).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(keys))]
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_chunk").alias("_c"), "_offset")
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(one.cast("long")).over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_chunk") == F.col("_c")]
    joined = local.join(offsets, on, "left")
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).drop("_local", "_offset", "_chunk", "_c", *names)
