"""A corpus made ready for training: toxic documents go, of near copies one stays, personal data is masked, sources are
mixed to target weights, and what remains is packed into batches.

Every stage takes any further columns, also ones named like its own working columns, and passes them on but for the last; an
empty table stays empty; null ids, sources and languages are values like others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import mixing, near, packing, pii, toxicity
from braidwork.llm.common import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, trained on the labelled ones among them, does not reject. Null and empty texts have the bias's
    score and stay unless all are toxic; equal texts go or stay together; without labels of both classes none is rejected
    unless all labels are toxic."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id (a null id comes last), of rows equal in id and text one. Null and
    empty texts are one group; texts without words are near only to their exact copies."""
    return near.deduplicated(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of personal data replaced by their kinds and n_chars recounted; null and empty texts stay as they
    are, copies are masked alike."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the schedule of the sources takes them, up to three times. Null and empty texts are never taken; a null
    source is one of its own; repeated rows are taken each by itself."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row: doc_id, size, bucket, width, batch and slot; a row that is taken several times has as many places, a text
    without words the least width."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", mask_private),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Trained models and sketches have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
