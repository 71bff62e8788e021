"""Best paths by relaxing all arcs at once, round by round, until no distance falls.

Ties go to fewer arcs, then to the smaller predecessor, input label and output label, so cycles of weight zero never
enter a path, and negative weights are fine; a negative cycle is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import Fst
from weftline.plans.fixpoint import NoFixpoint, empty
from weftline.semiring import is_zero
from weftline.session import discard, hold

BEST = "fst_id", "state"


def distances(fst: Fst, max_rounds: int | None = None) -> DataFrame:
    """fst_id, state, best: (w, hops, src, ilabel, olabel, weight) of the best way from the start to each reachable state."""
    arcs = fst.arcs.filter(~is_zero(F.col("weight")))
    none = F.lit(None).cast("long")
    first = F.struct(F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("hops"), none.alias("src"), none.alias("ilabel"), none.alias("olabel"), F.lit(0.0).alias("weight"))
    dist = hold(fst.meta.filter("start is not null").select("fst_id", F.col("start").alias("state"), first.alias("best"), F.lit(True).alias("moved")), "dist")
    limit = max_rounds or 1 + (fst.states.groupBy("fst_id").count().agg(F.max("count")).first()[0] or 0)
    for _ in range(limit):
        moved = dist.filter("moved").select("fst_id", F.col("state").alias("src"), F.col("best.w").alias("w"), F.col("best.hops").alias("hops"))
        way = F.struct((F.col("w") + F.col("weight")).alias("w"), (F.col("hops") + 1).alias("hops"), "src", "ilabel", "olabel", "weight")
        offers = moved.join(arcs, ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state"), way.alias("best"), F.lit(True).alias("moved"))
        # the old entry and the offers meet in one aggregation; (w, hops) decides whether a state has moved
        every = dist.select("fst_id", "state", "best", F.lit(False).alias("moved")).unionByName(offers)
        rank = F.struct(F.col("best.w"), F.col("best.hops"), F.col("moved"), F.col("best"))
        merged = every.groupBy(*BEST).agg(F.min(rank).alias("r")).select(*BEST, F.col("r.best").alias("best"), F.col("r.moved").alias("moved"))
        old, dist = dist, hold(merged, "dist", dist)
        discard(old)
        if empty(dist.filter("moved")):
            return dist.drop("moved")
    raise NoFixpoint("distances still fall after as many rounds as there are states: a negative cycle")


def weights(fst: Fst, max_rounds: int | None = None) -> DataFrame:
    """fst_id, state, w of the best way from the start to each reachable state: distances() without the ways.

    Rounds carry a number a state and no struct, so they aggregate by hash and needn't sort, and of arcs only ends and weight.
    """
    arcs = fst.arcs.filter(~is_zero(F.col("weight"))).select("fst_id", "src", "weight", "dst")
    dist = hold(fst.meta.filter("start is not null").select("fst_id", F.col("start").alias("state"), F.lit(0.0).alias("w"), F.lit(True).alias("moved")), "dist")
    limit = max_rounds or 1 + (fst.states.groupBy("fst_id").count().agg(F.max("count")).first()[0] or 0)
    none = F.lit(None).cast("double")
    for _ in range(limit):
        moved = dist.filter("moved").select("fst_id", F.col("state").alias("src"), "w")
        offers = moved.join(arcs, ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state"), none.alias("w"), (F.col("w") + F.col("weight")).alias("offer"))
        every = dist.select(*BEST, "w", none.alias("offer")).unionByName(offers).groupBy(*BEST).agg(F.min("w").alias("w"), F.min("offer").alias("offer"))
        merged = every.select(*BEST, F.least("w", "offer").alias("w"), F.coalesce(F.col("offer") < F.col("w"), F.col("w").isNull()).alias("moved"))
        old, dist = dist, hold(merged, "dist", dist)
        discard(old)
        if empty(dist.filter("moved")):
            return dist.drop("moved")
    raise NoFixpoint("distances still fall after as many rounds as there are states: a negative cycle")


def shortest_path(fst: Fst, n: int = 1) -> Fst:
    """The best path of each machine as a linear chain with the arcs' own weights and the final weight."""
    if n != 1:
        if n == 0:
            return fst.with_(meta=fst.meta.withColumn("start", F.lit(None).cast("long")), states=fst.states.limit(0), arcs=fst.arcs.limit(0))
        raise NotImplementedError("one best path only")
    dist = distances(fst)
    finals = fst.states.filter(F.col("final_weight").isNotNull() & ~is_zero(F.col("final_weight")))
    ends = dist.join(finals, list(BEST)).select("fst_id", F.struct((F.col("best.w") + F.col("final_weight")).alias("total"), F.col("best.hops").alias("hops"), "state", "final_weight").alias("e"))
    ends = hold(ends.groupBy("fst_id").agg(F.min("e").alias("e")).select("fst_id", "e.*"), "ends")
    at = hold(ends.select("fst_id", "state", "hops"), "trace")
    parts = []
    while not empty(at.filter("hops > 0")):
        step = at.filter("hops > 0").join(dist, list(BEST)).select("fst_id", (F.col("hops") - 1).alias("hops"), F.col("best.src").alias("state"), F.col("best.ilabel").alias("ilabel"), F.col("best.olabel").alias("olabel"), F.col("best.weight").alias("weight"))
        parts.append(hold(step, "trace"))
        at = parts[-1].select("fst_id", "state", "hops")
    arcs = fst.arcs.limit(0)
    for p in parts:
        arcs = arcs.unionByName(p.select("fst_id", F.col("hops").alias("src"), "ilabel", "olabel", "weight", (F.col("hops") + 1).alias("dst")))
    states = ends.select("fst_id", F.explode(F.sequence(F.lit(0).cast("long"), "hops")).alias("state"), "hops", "final_weight").select("fst_id", "state", F.when(F.col("state") == F.col("hops"), F.col("final_weight")).alias("final_weight"))
    meta = fst.meta.select("fst_id").join(ends.select("fst_id", F.lit(0).cast("long").alias("start")), "fst_id", "left")
    return fst.with_(meta=meta, states=states, arcs=arcs)


def total_weight(fst: Fst) -> DataFrame:
    """fst_id, weight: of the best path, for machines that accept anything."""
    finals = fst.states.filter(F.col("final_weight").isNotNull() & ~is_zero(F.col("final_weight")))
    return weights(fst).join(finals, list(BEST)).groupBy("fst_id").agg(F.min(F.col("w") + F.col("final_weight")).alias("weight"))
