"""State over batches: keys seen before, bounded filters, and per-update batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def per_update(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One call per batch that has arrived; a batch that is repeated after a failure has the same number, by which the
    handler's writes can be made once."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, key: str, at: str | None = None, late: str | None = None) -> DataFrame:
    """Each key once. With an event time `at` and a bound `late` keys are forgotten when none can come any more; without,
    all are kept for ever, as a set of prompts that must not repeat asks for."""
    if at is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def bounded_filter(groups: DataFrame, budget: int, target: int | None = None) -> DataFrame:
    """Groups (run, group_index, keep) with accept and released: of a rollout the first `budget` groups seen must be kept by
    their filter, those after are let through. With a `target` a rollout ends when so many are accepted, and the next group
    begins one of its own with all counters at 0. State: how many of the rollout were seen, kept, dropped and released; a
    batch's groups of a run, whose number the rollout's size bounds, are put in the order of their indices."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept, dropped, through = state.get if state.exists else (0, 0, 0, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("group_index").itertuples():
            if target and kept >= target:
                seen = kept = dropped = through = 0
            released = seen >= budget
            accept = released or bool(r.keep)
            seen, kept, dropped, through = seen + 1, kept + accept, dropped + (not accept), through + released
            out.append((key[0], r.group_index, accept, released, kept, dropped))
        state.update((seen, kept, dropped, through))
        yield pd.DataFrame(out, columns=["run", "group_index", "accept", "released", "kept", "dropped"])

    kinds = "run string, group_index long, accept boolean, released boolean, kept long, dropped long"
    return groups.groupBy("run").applyInPandasWithState(run, kinds, "seen long, kept long, dropped long, through long", "append", GroupStateTimeout.NoTimeout)
