"""Rules and machines as SQL functions of a session."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions.machine import Machine
from weftline.operators.rewrite import Rule, best_output_function
from weftline.plans.packed import Packed
from weftline.semiring import INF
from weftline.session import ship_by_value

ship_by_value(__name__)


def register_rule(spark: SparkSession, name: str, rule: Rule) -> None:
    """name(text): the text rewritten, or null."""
    spark.udf.register(name, rule.function())


def register_machine(spark: SparkSession, name: str, machine: Machine) -> None:
    """name(text): a struct of the best path's output and weight; null fields where the machine has no path."""
    spark.udf.register(name, best_output_function(machine))


class Paths:
    """The paths of a machine in binary form, one row each, epsilons left out; paths that relate the same are rows of their own.

    A path may have at most max_arcs arcs; null stands for all paths, and a cycle is an error then.
    """

    def eval(self, data: bytes, max_arcs: int | None) -> Iterator[tuple[bytes, bytes, float]]:
        if data is None:
            return
        m = Packed.from_bytes(bytes(data)).machine()
        if m.start is None:
            return
        todo = [(m.start, b"", b"", 0.0, 0)]
        byte = lambda x: bytes([x - 1]) if 0 < x < 257 else b""
        while todo:
            s, i, o, w, n = todo.pop()
            if m.finals[s] != INF:
                yield i, o, w + m.finals[s]
            if max_arcs is None and n > m.num_states:
                raise ValueError("a machine with a cycle has no end of paths: give max_arcs")
            if max_arcs is None or n < max_arcs:
                todo += [(d, i + byte(a), o + byte(b), w + v, n + 1) for a, b, v, d in reversed(m.arcs[s])]


def register_paths(spark: SparkSession, name: str = "fst_paths") -> None:
    """A table function: select * from t, lateral fst_paths(t.data, null) gives istring, ostring, weight of every path."""
    spark.udtf.register(name, F.udtf(Paths, returnType="istring binary, ostring binary, weight double"))


def register_semiring_sum(spark: SparkSession, name: str = "semiring_sum") -> None:
    """An aggregate: name(weight, semiring) with semiring 'tropical' or 'log'; nulls don't count, without weights it's infinite.

    SQL sees one group as one batch in a worker; the columns of weftline.semiring aggregate in parts and suit groups of any size.
    """

    @F.pandas_udf("double")
    def total(weight: pd.Series, semiring: pd.Series) -> float:
        w = weight.dropna()
        if not len(w):
            return INF
        kind, low = semiring.iloc[0], float(w.min())
        if kind == "tropical":
            return low
        if kind != "log":
            raise ValueError(f"semiring is tropical or log, not {kind}")
        return low if math.isinf(low) else low - math.log(sum(math.exp(low - x) for x in w))

    spark.udf.register(name, total)
