"""Rules and acceptors on streams.

A rule is stateless: its column expression works on a streaming DataFrame as it is. An acceptor that follows each
key's events keeps one state number a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.machine import Machine
from weftline.operators.rewrite import Rule
from weftline.session import ship_by_value

ship_by_value(__name__)


def rewrite_stream(events: DataFrame, rule: Rule, column: str) -> DataFrame:
    """events with the column rewritten."""
    return events.withColumn(column, rule.apply(F.col(column)))


def follow(events: DataFrame, machine: Machine, key: str, label: str, order: str) -> DataFrame:
    """key, seen, state, accepted after each batch: where a deterministic acceptor is after the key's events so far.

    Events of one key and batch go by `order`; an event without an arc ends in no state (null) for good.
    """
    step = {(s, i): d for s, a in enumerate(machine.arcs) for i, _, _, d in a}
    finals = {s for s in range(machine.num_states) if machine.is_final(s)}
    start = machine.start

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen = state.get if state.exists else (start, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[label]:
            at = step.get((at, int(x)), -1) if at is not None and at >= 0 else -1
            seen += 1
        state.update((at, seen))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "state": [at if at >= 0 else None], "accepted": [at in finals]}).astype({"state": "Int64"})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seen long, state long, accepted boolean", "at long, seen long", "update", GroupStateTimeout.NoTimeout)
