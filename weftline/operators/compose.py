"""Composition: the product of two machines where the first's output is the second's input.

A frontier of product states (s1, s2, filter) is expanded round by round. One join brings the first machine's arcs to
the frontier; a second, on (s2, label), covers matches and simultaneous epsilon moves; moves of one side alone need
no second join or one on epsilon arcs only. The filter lets exactly one order of epsilon moves through, so no path
is counted twice in any semiring. A product state's id is computed from its parts; only parts whose
ids are so large that a product's would not fit in a long are numbered anew first.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import Fst, same_space
from weftline.plans.fixpoint import NoFixpoint, empty
from weftline.semiring import is_zero
from weftline.session import discard, hold

STATE = ["fst_id", "s1", "s2", "f"]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merge_parallel(fst: Fst) -> Fst:
    """Arcs with equal ends and labels as one, with the sum of their weights; a column paths says how many each stands for.

    As times distributes over plus, the product of merged machines has the same weights and counts of paths. Only
    compose(), language() and remap() keep the counts.
    """
    paths = F.sum("paths") if "paths" in fst.arcs.columns else F.count(F.lit(1))
    # arcs of weight zero are on no path, so they stay apart
    arcs = fst.arcs.groupBy("fst_id", "src", "ilabel", "olabel", "dst", is_zero(F.col("weight")).alias("none")).agg(fst.semiring.plus("weight").alias("weight"), paths.alias("paths"))
    return replace(fst, arcs=arcs.select("fst_id", "src", "ilabel", "olabel", "weight", "dst", "paths"), chains=None)


def compose(a: Fst, b: Fst, shared: bool = False, max_rounds: int = 100_000) -> Fst:
    """Machines of equal fst_id are composed; shared: every machine of a with the only machine of b.

    Only states that can be reached are made; states from which no final state is reached are kept. Where arcs of a or b
    stand for several (merge_parallel), arcs of the product do.
    """
    same_space(a, b)
    many = "paths" in a.arcs.columns or "paths" in b.arcs.columns
    if many:
        a, b = (m if "paths" in m.arcs.columns else replace(m, arcs=m.arcs.withColumn("paths", F.lit(1).cast("long"))) for m in (a, b))
    # a product's id is made of its parts' ids, which have to leave room for that
    sizes = [m.states.agg(F.max("state"), F.min("state")).first() for m in (a, b)]
    if any((lo or 0) < 0 for _, lo in sizes) or ((sizes[0][0] or 0) + 1) * ((sizes[1][0] or 0) + 1) >= 2**61:
        a, b = a.renumber().cut("left"), b.renumber().cut("right")
    key = [] if shared else ["fst_id"]
    counts = lambda name: [F.col("paths").alias(name)] if many else []
    b_arcs = b.arcs.select(*key, F.col("src").alias("s2"), F.col("ilabel").alias("olabel"), F.col("olabel").alias("out2"), F.col("weight").alias("w2"), F.col("dst").alias("d2"), *counts("k2"))
    b_eps = b_arcs.filter("olabel = 0").drop("olabel")
    a_arcs = a.arcs.select("fst_id", F.col("src").alias("s1"), F.col("ilabel").alias("in1"), "olabel", F.col("weight").alias("w1"), F.col("dst").alias("d1"), *counts("k1"))
    b_meta = b.meta.select(*key, F.col("start").alias("s2"))
    starts = a.meta.select("fst_id", F.col("start").alias("s1"))
    starts = (starts.crossJoin(F.broadcast(b_meta)) if shared else starts.join(b_meta, "fst_id")).filter("s1 is not null and s2 is not null")
    zero = F.lit(0).cast("long")
    product = lambda *names: [reduce(Column.__mul__, map(F.col, names)).alias("paths")] if many else []
    new = seen = hold(starts.withColumn("f", F.lit(0)).select(*STATE), "frontier")
    states, arcs, made = [seen], [], None
    for _ in range(max_rounds):
        left = new.join(a_arcs, ["fst_id", "s1"])
        both = left.filter("olabel <> 0 or f = 0").join(b_arcs, [*key, "s2", "olabel"]).select(*STATE, F.col("d1").alias("t1"), F.col("d2").alias("t2"), F.lit(0).alias("g"), F.col("in1").alias("ilabel"), F.col("out2").alias("olabel"), a.semiring.times(F.col("w1"), F.col("w2")).alias("weight"), *product("k1", "k2"))
        one = left.filter("olabel = 0 and f <> 1").select(*STATE, F.col("d1").alias("t1"), F.col("s2").alias("t2"), F.lit(2).alias("g"), F.col("in1").alias("ilabel"), zero.alias("olabel"), F.col("w1").alias("weight"), *product("k1"))
        two = new.filter("f <> 2").join(b_eps, [*key, "s2"]).select(*STATE, F.col("s1").alias("t1"), F.col("d2").alias("t2"), F.lit(1).alias("g"), zero.alias("ilabel"), F.col("out2").alias("olabel"), F.col("w2").alias("weight"), *product("k2"))
        made = hold(both.unionByName(one).unionByName(two), "product", made)
        arcs.append(made)
        to = made.select("fst_id", F.col("t1").alias("s1"), F.col("t2").alias("s2"), F.col("g").alias("f")).distinct()
        new = hold(to.join(seen, STATE, "left_anti"), "frontier", new)
        if empty(new):
            break
        states.append(new)
        if len(states) >= 16:
            old, states = states, [hold(_all(states), "frontier")]
            discard(*old[:-1])
        if len(arcs) >= 16:
            old, arcs = arcs, [hold(_all(arcs), "product")]
            discard(*old)
        seen = _all(states)
    else:
        raise NoFixpoint(f"the product still grows after {max_rounds} rounds")
    width = b.states.groupBy(*key).agg((F.max("state") + 1).alias("n2")) if key else b.states.agg((F.max("state") + 1).alias("n2"))

    def numbered(s1: str, s2: str, f: str) -> Column:
        return ((F.col(s1) * F.col("n2") + F.col(s2)) * 3 + F.col(f)).cast("long")

    def wide(df: DataFrame) -> DataFrame:
        return df.join(width, key) if key else df.crossJoin(F.broadcast(width))  # one row if shared

    finals_a = a.states.filter("final_weight is not null").select("fst_id", F.col("state").alias("s1"), F.col("final_weight").alias("w1"))
    finals_b = b.states.filter("final_weight is not null").select(*key, F.col("state").alias("s2"), F.col("final_weight").alias("w2"))
    out_states = wide(_all(states)).join(finals_a, ["fst_id", "s1"], "left").join(finals_b, [*key, "s2"], "left")
    out_states = out_states.select("fst_id", numbered("s1", "s2", "f").alias("state"), (F.col("w1") + F.col("w2")).alias("final_weight"))
    out_arcs = wide(_all(arcs)).select("fst_id", numbered("s1", "s2", "f").alias("src"), "ilabel", "olabel", "weight", numbered("t1", "t2", "g").alias("dst"), *counts("paths"))
    live = wide(starts.withColumn("f", zero)).select("fst_id", numbered("s1", "s2", "f").alias("start"))
    meta = a.meta.select("fst_id").join(live, "fst_id", "left")
    return a.with_(meta=meta, states=out_states, arcs=out_arcs)


def intersect(a: Fst, b: Fst, shared: bool = False) -> Fst:
    """Of acceptors."""
    return compose(a, b, shared)
