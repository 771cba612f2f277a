"""Sinks: committed tables, ordered single files, audit batches, metrics, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines by the commit protocol; with an order one sorted file, for prompt sets whose bytes are released."""
    out = df.orderBy(*order).coalesce(1) if order else df
    out.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_audit(df: DataFrame, path: str, update: int) -> None:
    df.withColumn("update", F.lit(update)).write.mode("append").partitionBy("update").parquet(path)


def metrics(df: DataFrame, step: int) -> DataFrame:
    """(step, name, value) from one row of numbers."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {pairs}) as (name, value)").select(F.lit(step).alias("step"), "name", "value")


def sealed(df: DataFrame, path: str) -> DataFrame:
    """Writes a table, and gives its manifest: rows and a digest that does not depend on their order."""
    df.write.mode("overwrite").parquet(path)
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("part")), ","), 256)
    part = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(256)).alias("b"), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
    sums = part.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.col("b"), F.sum("h")).alias("part"))
    return sums.agg(F.sum("n").alias("rows"), digest.alias("digest")).withColumn("path", F.lit(path))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report's table; more than `most` rows are no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a table in a report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
