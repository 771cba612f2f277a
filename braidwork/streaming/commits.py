"""Tables of a run that grow update by update, each update once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class UpdateLog:
    """Tables under one root, with a folder for each update and a log of the updates that are whole.

    An update is written to folders of its number, over whatever an attempt before has left there, and then entered in the log.
    Readers take the updates in the log only, so a batch that failed after a write and is run again leaves one copy, and no
    reader sees one table of an update without the others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> list[int]:
        path, fs = self._path("_commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def commit(self, update: int, tables: dict[str, DataFrame]) -> bool:
        """Writes the tables as the update's; does nothing, and gives False, for an update that is in the log."""
        mark, fs = self._path("_commits", f"{update:012d}")
        if fs.exists(mark):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/update={update}")
        return bool(fs.createNewFile(mark))

    def read(self, name: str) -> DataFrame:
        """The rows of all updates in the log, with a column update."""
        done = self.committed()
        if not done:
            raise ValueError(f"no update of {self.root} is whole")
        paths = [f"{self.root}/{name}/update={u}" for u in done]
        return self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*paths).withColumn("update", F.col("update").cast("long"))


def updates(stream: DataFrame, log: UpdateLog, tables: Callable[[DataFrame, int], dict[str, DataFrame]], checkpoint: str) -> StreamingQuery:
    """One update for each batch that has arrived: what `tables` gives for it is committed under the batch's number."""

    def handle(df: DataFrame, number: int) -> None:
        held = df.persist()
        try:
            log.commit(number, tables(held, number))
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
