"""Sources: JSON lines lenient and strict, slices, mixtures, evaluation records, tables; all with declared schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.operators.ranges import ranges

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("input_sha256", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("correct", T.StringType()), T.StructField("mean_tokens", T.DoubleType()), T.StructField("cap_hits", T.IntegerType())])
GENERATION = "id string, input_sha256 string, model string, cap int, n int, responses array<string>, token_counts array<int>, finish_reasons array<string>"
PROMPT = "prompt array<struct<role:string,content:string>>, label string, domain string, teacher string, metadata struct<domain:string,data_source:string,src_index:bigint>"


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines); blank lines are neither."""
    parsed = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    full = T.StructType([*parsed.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    good = rows.where(F.col("r._bad").isNull() & F.col("r").isNotNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in parsed.fields])
    return good, rows.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_slice(path: str) -> tuple[str, int | None, int | None]:
    """`path@[a:b]`; negative bounds are refused."""
    m = re.fullmatch(r"(.+)@\[(-?\d*):(-?\d*)\]", path)
    if not m:
        return path, None, None
    lo, hi = (int(x) if x else None for x in m.group(2, 3))
    if (lo or 0) < 0 or (hi or 0) < 0:
        raise ValueError(f"negative slice bound in {path}")
    return m[1], lo, hi


def sliced(rows: DataFrame, order: str, lo: int | None, hi: int | None) -> DataFrame:
    """Rows lo to hi by an explicit order column that tells rows apart, from the ranges of an index that hold them."""
    if not lo and hi is None:
        return rows
    if not lo:
        return rows.orderBy(order).limit(hi)
    return ranges(rows, [order]).between(lo, hi, "_place").drop("_place")


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array each, named by the offset at which they start: their rows with start and place (in the
    file), by which they are in order."""
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    start = F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*\z", 1).cast("long")
    # A file is read by one task, in which numbers grow.
    rows = read.select("*", start.alias("start"), F.monotonically_increasing_id().alias("_id"))
    return rows.withColumn("place", F.col("_id") - F.min("_id").over(Window.partitionBy("start"))).drop("_id")


def json_document(spark: SparkSession, path: str, schema: str, field_: str) -> DataFrame:
    """One nested JSON document: the rows of an array of it, with their fields as columns."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(field_))


@dataclass
class Part:
    """One table of a mixture: its rows, renames (made only where the column exists) and a teacher for all of them."""

    rows: DataFrame
    renames: dict[str, str] = field(default_factory=dict)
    teacher: str | None = None


def mixture(parts: list[Part]) -> DataFrame:
    """All parts one after another: file_ord says which; missing columns are null."""

    def one(i: int, p: Part) -> DataFrame:
        df = p.rows
        for old, new in p.renames.items():
            if old != new and old in df.columns:
                df = df.withColumnRenamed(old, new)
        if p.teacher is not None:
            df = df.withColumn("teacher", F.lit(p.teacher))
        return df.withColumn("file_ord", F.lit(i))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(i, p) for i, p in enumerate(parts)])


def records(spark: SparkSession, root: str, layout: str | None = None) -> DataFrame:
    """Records with suite, cap and model from their paths: scores/<suite>/cap<cap>/<model>.jsonl, or of single runs
    <model>/<suite>/cap<cap>/scores.jsonl. Without a layout that of the files that are there; both or none is an error."""
    if layout is None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        there = {name: hadoop(f"{root}/{glob}") for name, glob in (("released", "scores/*/cap*/*.jsonl"), ("runs", "*/*/cap*/scores.jsonl"))}
        found = [name for name, path in there.items() if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)]
        if len(found) != 1:
            raise ValueError(f"{root} holds records in {'two layouts' if found else 'no known layout'}")
        layout = found[0]
    glob, pattern = {"released": (f"{root}/scores/*/cap*/*.jsonl", r"([^/]+)/cap(\d+)/([^/]+)\.jsonl$"), "runs": (f"{root}/*/*/cap*/scores.jsonl", r"([^/]+)/([^/]+)/cap(\d+)/scores\.jsonl$")}[layout]
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(glob).withColumn("_p", F.col("_metadata.file_path"))
    suite, cap, model = (1, 2, 3) if layout == "released" else (2, 3, 1)
    take = lambda i: F.regexp_extract("_p", pattern, i)
    return rows.withColumns({"suite": take(suite), "cap": take(cap).cast("int"), "model": take(model)}).drop("_p")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))


def generations(rows: DataFrame) -> DataFrame:
    """One row per sampled answer, with its place."""
    z = F.arrays_zip("responses", "token_counts", "finish_reasons")
    return rows.select("id", "input_sha256", "model", "cap", F.posexplode(z).alias("sample", "x")).select("id", "input_sha256", "model", "cap", "sample", F.col("x.responses").alias("response"), F.col("x.token_counts").alias("tokens"), F.col("x.finish_reasons").alias("finish_reason"))


def complete_shards(spark: SparkSession, root: str) -> list[str]:
    """Shard folders whose writer has committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS"))
    return sorted(s.getPath().getParent().toString() for s in (done or []))
