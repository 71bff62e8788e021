"""Loops over DataFrames: one job a round, each round's table written to the shared folder, no lineage carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import discard, hold


class NoFixpoint(RuntimeError):
    pass


def reach(start: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int = 100_000) -> DataFrame:
    """All rows of `keys` reachable from start over edges (keys, next_<last key>); start has the keys."""
    *same, last = keys
    seen = new = hold(start.select(*keys).distinct(), "reach")
    parts = [seen]
    for _ in range(max_rounds):
        step = new.join(edges, keys).select(*same, F.col(f"next_{last}").alias(last)).distinct()
        new = hold(step.join(seen, keys, "left_anti"), "reach", new)
        if empty(new):
            return seen
        parts.append(new)
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        if len(parts) >= 16:  # few files stay few
            seen = hold(seen, "reach")
            discard(*parts)
            parts = [seen]
    raise NoFixpoint(f"still new states after {max_rounds} rounds")


def empty(df: DataFrame) -> bool:
    known = getattr(df, "_weftline_rows", None)
    return not df.limit(1).count() if known is None else not known
