"""The interval map of weft.operators.intervals in the state of a streaming query."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.intervals import IntervalMap

STATE = "starts array<bigint>, ends array<bigint>"
OUTPUT = "entity string, gap_start bigint, gap_end bigint, state string"


def _update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = state.get if state.exists else ([], [])
    known = IntervalMap([int(x) for x in kept[0]], [int(x) for x in kept[1]])
    before = set(known.gaps())
    for rows in batches:
        for s, e in zip(rows["s"].tolist(), rows["e"].tolist(), strict=True):
            known.insert(s, e)
    state.update((known.starts, known.ends))
    after = set(known.gaps())
    changed = [(key[0], *g, "open") for g in sorted(after - before)] + [(key[0], *g, "closed") for g in sorted(before - after)]
    yield pd.DataFrame(changed, columns=["entity", "gap_start", "gap_end", "state"]).astype({"gap_start": "int64", "gap_end": "int64"})


def gap_changes(rows: DataFrame) -> DataFrame:
    """Gaps that a micro-batch of spans() opens or closes, per entity; late spans may close earlier gaps."""
    return rows.groupBy("entity").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
