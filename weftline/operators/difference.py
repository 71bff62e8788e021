"""Difference of acceptors: composition with the completed complement of the second one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import Fst, same_space
from weftline.operators.compose import compose


class InvalidDifference(ValueError):
    pass


def complement(b: Fst, labels: DataFrame) -> Fst:
    """All strings over labels (fst_id, label) that the deterministic acceptor b doesn't accept.

    Missing arcs lead to a new state, whose id is the first one above b's; what is final and what isn't change places.
    """
    sink = b.states.groupBy("fst_id").agg((F.max("state") + 1).alias("sink"))
    states = b.states.select("fst_id", "state", F.when(F.col("final_weight").isNull(), F.lit(0.0)).alias("final_weight"))
    states = states.unionByName(sink.select("fst_id", F.col("sink").alias("state"), F.lit(0.0).alias("final_weight")))
    wanted = states.select("fst_id", F.col("state").alias("src")).join(labels.distinct(), "fst_id")
    missing = wanted.join(b.arcs.select("fst_id", "src", F.col("ilabel").alias("label")), ["fst_id", "src", "label"], "left_anti").join(sink, "fst_id")
    arcs = b.arcs.unionByName(missing.select("fst_id", "src", F.col("label").alias("ilabel"), F.col("label").alias("olabel"), F.lit(0.0).alias("weight"), F.col("sink").alias("dst")))
    return b.with_(states=states, arcs=arcs)


def difference(a: Fst, b: Fst) -> Fst:
    """What a accepts and b doesn't. a is an acceptor; b an unweighted, epsilon-free, deterministic one."""
    same_space(a, b)
    if a.properties().filter("not acceptor").take(1) or b.properties().filter("not (acceptor and epsilon_free and deterministic and unweighted)").take(1):
        raise InvalidDifference("difference takes an acceptor and an unweighted, epsilon-free, deterministic acceptor")
    of = lambda m: m.arcs.filter("ilabel <> 0").select("fst_id", F.col("ilabel").alias("label"))
    live = b.meta.filter("start is not null").select("fst_id")
    some = a.with_(meta=a.meta.join(live, "fst_id", "left_semi"))
    out = compose(some, complement(b, of(a).unionByName(of(b))))
    # machines whose partner accepts nothing stay as they are
    rest = a.meta.join(live, "fst_id", "left_anti")
    keep = lambda df: df.join(rest.select("fst_id"), "fst_id", "left_semi")
    return a.with_(meta=out.meta.unionByName(rest), states=out.states.unionByName(keep(a.states)), arcs=out.arcs.unionByName(keep(a.arcs)))
