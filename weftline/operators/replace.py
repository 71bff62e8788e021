"""Recursive replacement: arcs whose input label names a machine are replaced by a copy of that machine.

The labels' dependencies (as many as there are rules) are sorted on the driver, leaves first; each inlining is a join
of the arcs with that label, numbered, and an explode-free product with the machine's states and arcs.
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import functions as F

from weftline.model import CELLS, Fst, same_space
from weftline.operators.rational import _epsilon, _next
from weftline.plans.prefix import numbered


class CyclicDependency(ValueError):
    pass


def inline(root: Fst, label: int, sub: Fst) -> Fst:
    """Every arc of root with that input label becomes epsilon to a copy of sub and, with the arc's weight, epsilon out.

    An empty machine leaves the arcs as they are.
    """
    m = sub.meta.first()
    if m is None or m["start"] is None:
        return root
    size = sub.states.agg(F.max("state")).first()[0] + 1
    # every arc gets a copy of its own, so the product below is the result itself; Spark broadcasts sub if it is small
    hits = root.arcs.filter(F.col("ilabel") == label).withColumn("cell", F.pmod(F.xxhash64("src"), F.lit(CELLS)))
    hits = numbered(hits, ["fst_id"], "cell", [F.col(c) for c in ("src", "olabel", "weight", "dst")], "k")
    hits = hits.join(_next(root), "fst_id").withColumn("base", F.col("n") + F.col("k") * size)
    at = lambda c: (F.col("base") + F.col(c)).alias(c)
    own = sub.states.select("state", "final_weight")
    arcs = sub.arcs.select(F.col("src").alias("s"), F.col("ilabel").alias("i"), F.col("olabel").alias("o"), F.col("weight").alias("w"), F.col("dst").alias("d"))
    where = hits.select("fst_id", "base")
    states = where.crossJoin(own.select("state")).select("fst_id", at("state"), F.lit(None).cast("double").alias("final_weight"))
    inner = where.crossJoin(arcs).select("fst_id", at("s").alias("src"), F.col("i").alias("ilabel"), F.col("o").alias("olabel"), F.col("w").alias("weight"), at("d").alias("dst"))
    enter = _epsilon(hits.withColumn("to", F.col("base") + m["start"]), "src", "to")
    leave = hits.crossJoin(own.filter("final_weight is not null"))
    leave = _epsilon(leave.withColumn("from", F.col("base") + F.col("state")), "from", "dst", F.col("weight") + F.col("final_weight"))
    kept = root.arcs.filter(F.col("ilabel") != label)
    return root.with_(states=root.states.unionByName(states), arcs=kept.unionByName(inner).unionByName(enter).unionByName(leave))


def replace(root: Fst, rules: list[tuple[int, Fst]]) -> Fst:
    """rules: (label, batch of one machine); of a label that is given twice the last machine counts."""
    named = dict(rules)
    for sub in named.values():
        same_space(root, sub)
    needs = {}
    for label, sub in named.items():
        needs[label] = {r["ilabel"] for r in sub.arcs.filter(F.col("ilabel").isin(list(named))).select("ilabel").distinct().collect()}
    try:
        order = list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise CyclicDependency(f"labels {e.args[1]} contain each other") from e
    for label in order:
        for inner in sorted(needs[label], key=order.index):
            named[label] = inline(named[label], inner, named[inner]).cut("replace")
    for label in order:
        root = inline(root, label, named[label]).cut("replace")
    return root
