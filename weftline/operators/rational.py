"""Rational operations: each is a projection, a union and at most a join on fst_id.

Binary operations pair the machines of equal fst_id. New states get ids above those there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import Fst, same_space

def _no_weight() -> Column:
    return F.lit(None).cast("double")


def _next(fst: Fst, name: str = "n") -> DataFrame:
    """fst_id and the first id above its states."""
    n = fst.states.groupBy("fst_id").agg((F.max("state") + 1).alias(name))
    return fst.meta.select("fst_id").join(n, "fst_id", "left").select("fst_id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def _shifted(fst: Fst, by: DataFrame, name: str) -> Fst:
    """State ids raised by a column of by (fst_id, name)."""
    add = lambda c: (F.col(c) + F.col(name)).alias(c)
    meta = fst.meta.join(by, "fst_id").select("fst_id", add("start"))
    states = fst.states.join(by, "fst_id").select("fst_id", add("state"), "final_weight")
    arcs = fst.arcs.join(by, "fst_id").select("fst_id", add("src"), "ilabel", "olabel", "weight", add("dst"))
    return fst.with_(meta=meta, states=states, arcs=arcs)


def _epsilon(rows: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.select("fst_id", F.col(src).alias("src"), zero.alias("ilabel"), zero.alias("olabel"), (F.lit(0.0) if weight is None else weight).alias("weight"), F.col(dst).alias("dst"))


def _finals(fst: Fst) -> DataFrame:
    return fst.states.filter("final_weight is not null")


def union(a: Fst, b: Fst) -> Fst:
    """A new start with epsilons to both starts; machines whose partner is empty stay as they are."""
    same_space(a, b)
    n = _next(a, "n").join(_next(b, "m"), "fst_id")
    there = b.meta.filter("start is not null").select("fst_id")
    n = n.join(there, "fst_id", "left_semi")
    moved = _shifted(b, n.select("fst_id", "n"), "n")
    top = n.select("fst_id", (F.col("n") + F.col("m")).alias("top"))
    starts = a.meta.filter("start is not null").unionByName(moved.meta).join(top, "fst_id")
    meta = a.meta.join(top, "fst_id", "left").select("fst_id", F.coalesce("top", "start").alias("start"))
    states = a.states.unionByName(moved.states).unionByName(top.select("fst_id", F.col("top").alias("state"), _no_weight().alias("final_weight")))
    return a.with_(meta=meta, states=states, arcs=a.arcs.unionByName(moved.arcs).unionByName(_epsilon(starts, "top", "start")))


def concat(a: Fst, b: Fst) -> Fst:
    """Epsilons from a's final states to b's start; the empty language times anything is empty."""
    same_space(a, b)
    moved = _shifted(b, _next(a), "n")
    links = _finals(a).join(moved.meta.filter("start is not null"), "fst_id")
    states = a.states.withColumn("final_weight", _no_weight()).unionByName(moved.states)
    arcs = a.arcs.unionByName(moved.arcs).unionByName(_epsilon(links, "state", "start", F.col("final_weight")))
    return a.with_(states=states, arcs=arcs)


def closure(fst: Fst, kind: str = "star") -> Fst:
    """star, plus or ques. The star and ques of the empty language accept the empty string."""
    if kind not in ("star", "plus", "ques"):
        raise ValueError(f"closure is star, plus or ques, not {kind}")
    arcs, states, meta = fst.arcs, fst.states, fst.meta
    start = fst.meta.filter("start is not null")
    if kind != "ques":
        arcs = arcs.unionByName(_epsilon(_finals(fst).join(start, "fst_id"), "state", "start", F.col("final_weight")))
    if kind != "plus":
        top = _next(fst, "top")
        states = states.unionByName(top.select("fst_id", F.col("top").alias("state"), F.lit(0.0).alias("final_weight")))
        arcs = arcs.unionByName(_epsilon(start.join(top, "fst_id"), "top", "start"))
        meta = top.select("fst_id", F.col("top").alias("start"))
    return fst.with_(meta=meta, states=states, arcs=arcs)


def repeat(fst: Fst, least: int, most: int) -> Fst:
    """From least to most copies in a row. Copies are made by one explode, not one operation each."""
    if least < 0 or most < least:
        raise ValueError(f"repeat from {least} to {most}")
    n = _next(fst)
    copies = n.select("fst_id", "n", F.explode(F.sequence(F.lit(0), F.lit(max(0, most - 1)))).alias("copy")) if most else n.select("fst_id", "n", F.lit(0).alias("copy")).limit(0)
    at = lambda c: (F.col(c) + F.col("copy") * F.col("n")).alias(c)
    states = fst.states.join(copies, "fst_id").select("fst_id", at("state"), F.when(F.col("copy") >= least - 1, F.col("final_weight")).alias("final_weight"))
    arcs = fst.arcs.join(copies, "fst_id").select("fst_id", at("src"), "ilabel", "olabel", "weight", at("dst"))
    start = fst.meta.filter("start is not null")
    follow = _finals(fst).join(start, "fst_id").join(copies.filter(F.col("copy") < most - 1), "fst_id")
    links = follow.select("fst_id", "final_weight", at("state"), (F.col("start") + (F.col("copy") + 1) * F.col("n")).alias("next"))
    arcs = arcs.unionByName(_epsilon(links, "state", "next", F.col("final_weight")))
    meta = fst.meta
    if least == 0:  # a new start that is final
        top = n.select("fst_id", (F.col("n") * most).cast("long").alias("top"))
        states = states.unionByName(top.select("fst_id", F.col("top").alias("state"), F.lit(0.0).alias("final_weight")))
        if most:
            arcs = arcs.unionByName(_epsilon(start.join(top, "fst_id"), "top", "start"))
        meta = top.select("fst_id", F.col("top").alias("start"))
    return fst.with_(meta=meta, states=states, arcs=arcs)


def reverse(fst: Fst) -> Fst:
    top = _next(fst, "top")
    live = fst.meta.filter("start is not null").select("fst_id", F.col("start").alias("old")).join(top, "fst_id")
    arcs = fst.arcs.select("fst_id", F.col("dst").alias("src"), "ilabel", "olabel", "weight", F.col("src").alias("dst"))
    arcs = arcs.unionByName(_epsilon(_finals(fst).join(live, "fst_id"), "top", "state", F.col("final_weight")))
    states = fst.states.join(live, "fst_id", "left").select("fst_id", "state", F.when(F.col("state") == F.col("old"), F.lit(0.0)).alias("final_weight"))
    states = states.unionByName(live.select("fst_id", F.col("top").alias("state"), _no_weight().alias("final_weight")))
    meta = fst.meta.select("fst_id").join(live, "fst_id", "left").select("fst_id", F.col("top").alias("start"))
    return fst.with_(meta=meta, states=states, arcs=arcs)


def invert(fst: Fst) -> Fst:
    return fst.with_(arcs=fst.arcs.select("fst_id", "src", F.col("olabel").alias("ilabel"), F.col("ilabel").alias("olabel"), "weight", "dst"))


def project(fst: Fst, side: str = "input") -> Fst:
    if side not in ("input", "output"):
        raise ValueError(f"side is input or output, not {side}")
    kept, other = ("ilabel", "olabel") if side == "input" else ("olabel", "ilabel")
    return fst.with_(arcs=fst.arcs.withColumn(other, F.col(kept)).select("fst_id", "src", "ilabel", "olabel", "weight", "dst"))
