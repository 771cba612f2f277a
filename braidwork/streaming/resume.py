"""State that a run keeps for each domain or prompt, and that a new run takes over from the audit table of an earlier one.

The state store is Spark's RocksDB provider, set here where the session has none of its own: state grows with the prompts, and
a batch touches only its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, initial: DataFrame | None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    start = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "None", initialState=start)


class Frozen(StatefulProcessor):
    """A domain's first measurable multiplier and its step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "multiplier double, since long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for r in initialState.itertuples():
            self.kept.update((float(r.multiplier), int(r.since)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, out = self.kept.get() if self.kept.exists() else None, []
        # A domain has one row a step: a batch's are few, and come in the order of steps only when sorted.
        for r in pd.concat(list(rows)).sort_values("step").itertuples():
            if kept is None and r.measurable:
                kept = (float(r.multiplier), int(r.step))
                self.kept.update(kept)
            out.append((int(r.step), key[0], float(r.multiplier) if kept is None else kept[0], None if kept is None else kept[1]))
        yield pd.DataFrame(out, columns=["step", "domain", "applied", "since"]).astype({"since": "Int64"})

    def close(self) -> None:
        pass


def frozen_from(audit: DataFrame, before: int) -> DataFrame:
    """(domain, multiplier, since): the first measurable multiplier of each domain among rows (step, domain, multiplier,
    measurable) before the step at which a run goes on."""
    seen = audit.where(F.col("measurable") & (F.col("step") < before))
    return seen.groupBy("domain").agg(F.min_by("multiplier", "step").alias("multiplier"), F.min("step").alias("since"))


def frozen_multipliers(found: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(step, domain, applied, since) for a stream (step, domain, multiplier, measurable): the first measurable multiplier
    applies from its step on. `initial`, as frozen_from() gives it, is where a resumed run begins."""
    return _stateful(found, ["domain"], Frozen(), "step long, domain string, applied double, since long", initial)


class LastApplied(StatefulProcessor):
    """For each slot of a prompt the sample it was last met at, and its teacher then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "slot int", "index long, teacher string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for r in initialState.rename(columns={"index": "at"}).itertuples():
            self.last.updateValue((int(r.slot),), (int(r.at), r.teacher))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        # A prompt has a few responses in a batch, which are put in the order of samples.
        for r in pd.concat(list(rows)).rename(columns={"index": "at"}).sort_values("at").itertuples():
            slot = (int(r.slot),)
            before = self.last.getValue(slot)[1] if self.last.containsKey(slot) else None
            out.append((int(r.at), key[0], int(r.slot), r.teacher, before, before is not None, before is not None and before != r.teacher))
            self.last.updateValue(slot, (int(r.at), r.teacher))
        yield pd.DataFrame(out, columns=["index", "prompt_sha256", "slot", "teacher", "previous", "repeat", "switched"])

    def close(self) -> None:
        pass


def teacher_switches(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Adds previous, repeat and switched to a stream (prompt_sha256, slot, index, teacher). `initial`, as
    operators.hook.memory() gives it from audit rows before the resumed batch, is where a resumed run begins."""
    own = rows.select("prompt_sha256", F.col("slot").cast("int").alias("slot"), "index", "teacher")
    schema = "index long, prompt_sha256 string, slot int, teacher string, previous string, repeat boolean, switched boolean"
    return _stateful(own, ["prompt_sha256"], LastApplied(), schema, initial)


class Waiting(StatefulProcessor):
    """The samples of a run that are not finished, each by itself with the step at which it was first seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "index long", "step long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for r in initialState.rename(columns={"index": "at"}).itertuples():
            self.first.updateValue((int(r.at),), (int(r.step),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).rename(columns={"index": "at"}).sort_values(["step", "at"]).itertuples():
            at = (int(r.at),)
            first = self.first.getValue(at)[0] if self.first.containsKey(at) else int(r.step)
            if r.status in ("completed", "truncated"):
                out.append((key[0], int(r.at), first, int(r.step), first < r.step))
                self.first.removeKey(at)
            elif first == r.step:
                self.first.updateValue(at, (first,))
        yield pd.DataFrame(out, columns=["run", "index", "first_step", "step", "off_policy"])

    def close(self) -> None:
        pass


def partial_buffer(samples: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(run, index, first_step, step, off_policy) of finished samples of a stream (run, step, index, status); a batch reads and
    writes the state of its own samples only. `initial`: (run, index, step) of samples that wait from before."""
    return _stateful(samples, ["run"], Waiting(), "run string, index long, first_step long, step long, off_policy boolean", initial)
