"""A stream that goes through a table again and again, each epoch in an order of its own, and knows where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from braidwork.operators.ranges import Ranges, permuted

#: Steps that one task numbers.
STEPS = 1 << 20


class Steps(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class EpochReader(DataSourceStreamReader):
    """Offsets are (epoch, slot); a batch goes `batch` steps on, at most to `until` in all."""

    def __init__(self, options: dict):
        self.total, self.batch, self.seed = (int(options[k]) for k in ("total", "batch", "seed"))
        self.until = int(options["until"]) if "until" in options else None
        self.start = int(options.get("start", 0))
        self.at: int | None = None

    def _offset(self, step: int) -> dict:
        return {"epoch": step // self.total, "slot": step % self.total}

    def _step(self, offset: dict) -> int:
        return int(offset["epoch"]) * self.total + int(offset["slot"])

    def initialOffset(self) -> dict:  # noqa: N802
        return self._offset(self.start)

    def latestOffset(self) -> dict:  # noqa: N802
        # After a restart partitions() of the last batch comes first, or commit(); else the stream begins.
        self.at = (self.start if self.at is None else self.at) + self.batch
        if self.until is not None:
            self.at = min(self.at, self.until)
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[Steps]:
        first, last = self._step(start), self._step(end)
        self.at = max(self.at or 0, last)
        return [Steps(k, min(k + STEPS, last)) for k in range(first, last, STEPS)]

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, self._step(end))

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        for k in range(partition.first, partition.end, 1 << 16):
            step = np.arange(k, min(k + (1 << 16), partition.end), dtype=np.int64)
            epoch, slot = step // self.total, step % self.total
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (step, epoch, slot, permuted(slot, self.total, self.seed, epoch))], names=["step", "epoch", "slot", "item"])


class EpochSource(DataSource):
    """Format `epochs`: rows (step, epoch, slot, item), item being a place of the table."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return "step long, epoch long, slot long, item long"

    def streamReader(self, schema) -> EpochReader:  # noqa: N802
        return EpochReader(self.options)


def steps(spark: SparkSession, total: int, batch: int, seed: int, until: int | None = None, start: int = 0) -> DataFrame:
    """The endless stream of steps through a table of `total` rows, `batch` of them in each batch; it ends at step `until` if
    that is given. The checkpoint keeps the place, so a stream that is stopped goes on without a gap or repeat."""
    if total < 1 or batch < 1:
        raise ValueError("a stream of epochs needs rows, and batches of at least one")
    spark.dataSource.register(EpochSource)
    made = spark.readStream.format("epochs").option("total", total).option("batch", batch).option("seed", seed).option("start", start)
    return (made if until is None else made.option("until", until)).load()


def samples(index: Ranges, batch: DataFrame) -> DataFrame:
    """For foreachBatch: the steps of a batch with the rows of the table at their items."""
    return index.at(batch, "item").drop("item")
