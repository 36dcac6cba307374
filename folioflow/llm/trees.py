"""States of partitions, merged in a tree: a few in each task, level by level, until one is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, tidy, written

#: States that one task merges.
FAN = 16
STATE = pa.schema([("node", pa.int64()), ("state", pa.binary())])


def partition_states(rows: DataFrame, step: Callable, finish: Callable[[object], bytes]) -> DataFrame:
    """node (the partition), state: step(state so far, record batch) over each partition that has rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                state = step(state, b)
        if state is not None:
            yield batch(STATE, [TaskContext.get().partitionId()], [finish(state)])

    return rows.mapInArrow(tidy(task), "node long, state binary")


def tree(states: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int = FAN) -> bytes | None:
    """One state of all rows (node, state), whose size doesn't depend on their number; null without rows."""
    table = written(states, "states")

    def task(group: pa.Table) -> pa.Table:
        rows = group.sort_by("node")
        return pa.table({"node": [rows["node"][0].as_py() // fan], "state": [merge(rows["state"].to_pylist())]}, schema=STATE)

    while table.count() > 1:
        up = table.groupBy(F.floor(F.col("node") / fan).alias("up")).applyInArrow(lambda t: task(t.select(["node", "state"])), "node long, state binary")
        before, table = table, written(up, "states")
        discard(before)
    row = table.first()
    discard(table)
    return bytes(row["state"]) if row else None
