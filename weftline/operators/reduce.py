"""Epsilon removal, trimming, determinization, minimization and the pipeline of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import MAX_LABEL, Fst, ranked
from weftline.plans.fixpoint import NoFixpoint, empty, reach
from weftline.session import discard, hold, row_count

IS_EPSILON = "ilabel = 0 and olabel = 0"


class NotAnAcceptor(ValueError):
    pass


def epsilon_distances(fst: Fst, max_rounds: int = 10_000) -> DataFrame:
    """fst_id, src, dst, w: the sum over all epsilon paths between two states, the empty path included.

    In an idempotent semiring only pairs whose distance falls go on; otherwise every path counts, and an epsilon cycle
    is an error, as its sum is infinite.
    """
    eps = fst.arcs.filter(IS_EPSILON).groupBy("fst_id", "src", "dst").agg(fst.semiring.plus("weight").alias("weight"))
    eps = eps.select("fst_id", F.col("src").alias("mid"), F.col("dst").alias("to"), "weight")
    done = new = hold(fst.states.select("fst_id", F.col("state").alias("src"), F.col("state").alias("dst"), F.lit(0.0).alias("w")), "eps")
    limit = max_rounds if fst.semiring.idempotent else 1 + (fst.states.groupBy("fst_id").count().agg(F.max("count")).first()[0] or 0)
    for _ in range(limit):
        step = new.withColumnRenamed("dst", "mid").join(eps, ["fst_id", "mid"]).groupBy("fst_id", "src", F.col("to").alias("dst")).agg(fst.semiring.plus(F.col("w") + F.col("weight")).alias("w"))
        if fst.semiring.idempotent:
            step = step.join(done.withColumnRenamed("w", "old"), ["fst_id", "src", "dst"], "left").filter("old is null or w < old").drop("old")
        step = hold(step, "eps", new)
        if empty(step):
            return done
        old, new = done, step
        done = hold(old.unionByName(step).groupBy("fst_id", "src", "dst").agg(fst.semiring.plus("w").alias("w")), "eps")
        discard(old)
    raise NoFixpoint("an epsilon cycle whose weights have no finite sum")


def rm_epsilon(fst: Fst) -> Fst:
    """The same machine without arcs that are epsilon on both tapes; all states stay."""
    if empty(fst.arcs.filter(IS_EPSILON)):
        return fst
    way = epsilon_distances(fst)
    real = fst.arcs.filter(f"not ({IS_EPSILON})").select("fst_id", F.col("src").alias("dst"), "ilabel", "olabel", "weight", F.col("dst").alias("to"))
    arcs = way.join(real, ["fst_id", "dst"]).groupBy("fst_id", "src", "ilabel", "olabel", F.col("to").alias("dst")).agg(fst.semiring.plus(F.col("w") + F.col("weight")).alias("weight"))
    finals = fst.states.filter("final_weight is not null").select("fst_id", F.col("state").alias("dst"), "final_weight")
    finals = way.join(finals, ["fst_id", "dst"]).groupBy("fst_id", F.col("src").alias("state")).agg(fst.semiring.plus(F.col("w") + F.col("final_weight")).alias("final_weight"))
    states = fst.states.select("fst_id", "state").join(finals, ["fst_id", "state"], "left")
    return fst.with_(states=states, arcs=arcs.select("fst_id", "src", "ilabel", "olabel", "weight", "dst")).cut("rmeps")


def connect(fst: Fst) -> Fst:
    """States on a path from the start to a final state, renumbered in their old order."""
    edges = fst.arcs.select("fst_id", F.col("src").alias("state"), F.col("dst").alias("next_state"))
    back = edges.select("fst_id", F.col("next_state").alias("state"), F.col("state").alias("next_state"))
    keys = ["fst_id", "state"]
    front = reach(fst.meta.filter("start is not null").select("fst_id", F.col("start").alias("state")), edges, keys)
    rear = reach(fst.states.filter("final_weight is not null").select(*keys), back, keys)
    live = hold(fst.states.join(front, keys, "left_semi").join(rear, keys, "left_semi"), "live", fst.arcs)
    ranks = hold(ranked(live), "ranks", live)  # computed once, as three tables need it
    end = lambda c: ranks.select("fst_id", F.col("state").alias(c), F.col("to").alias(f"new_{c}"))
    states = live.join(ranks, keys).select("fst_id", F.col("to").alias("state"), "final_weight")
    arcs = fst.arcs.join(end("src"), ["fst_id", "src"]).join(end("dst"), ["fst_id", "dst"])
    arcs = arcs.select("fst_id", F.col("new_src").alias("src"), "ilabel", "olabel", "weight", F.col("new_dst").alias("dst"))
    meta = fst.meta.join(end("start"), ["fst_id", "start"], "left").select("fst_id", F.col("new_start").alias("start"))
    return fst.with_(meta=hold(meta, "connect-meta"), states=hold(states, "connect-states", live), arcs=hold(arcs, "connect-arcs", live), dense=True)


def determinize(fst: Fst, drop_epsilon: bool = False, max_rounds: int = 10_000, max_states: int = 10_000_000) -> Fst:
    """An equivalent acceptor with one arc at most for each state and label (weighted subset construction).

    A state of the result is a set of (state, residual weight); residuals are rounded to 9 places, so that sets meet
    again. Epsilons are removed first, or dropped on request. max_states guards against machines that have no
    deterministic equivalent. A set is known by a 64-bit hash: among n sets two are taken for one by chance with
    probability n^2 / 2^65.
    """
    if not empty(fst.arcs.filter("ilabel <> olabel")):
        raise NotAnAcceptor("determinize takes acceptors; encode label pairs first")
    if drop_epsilon:
        fst = fst.with_(arcs=fst.arcs.filter("ilabel <> 0"))
    elif not empty(fst.arcs.filter("ilabel = 0")):
        fst = rm_epsilon(fst)
    plus = fst.semiring.plus
    arcs = fst.arcs.select("fst_id", F.col("src").alias("q"), F.col("ilabel").alias("label"), "weight", "dst")
    one = F.array(F.struct(F.col("start").alias("q"), F.lit(0.0).alias("r")))
    # a subset's id is a hash of it: the array itself is carried once a state and never a key
    first = hold(fst.meta.filter("start is not null").select("fst_id", F.xxhash64(one).alias("state"), one.alias("subset")), "subsets")
    new, seen, parts, made = first, [first.select("fst_id", "state")], [], []
    for _ in range(max_rounds):
        members = new.select("fst_id", "state", F.explode("subset").alias("m")).select("fst_id", "state", "m.*")
        to = members.join(arcs, ["fst_id", "q"]).groupBy("fst_id", "state", "label", "dst").agg(plus(F.col("r") + F.col("weight")).alias("w"))
        common = to.groupBy("fst_id", "state", "label").agg(plus("w").alias("common"), F.collect_list(F.struct("dst", "w")).alias("to"))
        rest = F.transform(F.array_sort("to"), lambda x: F.struct(x["dst"].alias("q"), F.round(x["w"] - F.col("common"), 9).alias("r")))
        step = common.select("fst_id", "state", "label", F.col("common").alias("weight"), rest.alias("subset"))
        step = hold(step.withColumn("next", F.xxhash64("subset")), "subset-arcs", parts[-1] if parts else None)
        if empty(step):
            break
        made.append(step.select("fst_id", "state", "label", "weight", "next"))
        parts.append(step)
        met = step.select("fst_id", F.col("next").alias("state"), "subset")
        new = met.dropDuplicates(["fst_id", "state"]).join(reduce(DataFrame.unionByName, seen), ["fst_id", "state"], "left_anti")
        seen.append(met.select("fst_id", "state"))
        if len(parts) % 16 == 0:
            new, seen = hold(new, "subsets"), [hold(reduce(DataFrame.unionByName, seen).distinct(), "subsets")]
            if row_count(seen[0]) > max_states:
                raise NoFixpoint(f"more than {max_states} states: the machine may have no deterministic equivalent")
    else:
        raise NoFixpoint("subsets still grow")
    every = [first, *(p.select("fst_id", F.col("next").alias("state"), "subset") for p in parts)]
    sets = hold(reduce(DataFrame.unionByName, every).dropDuplicates(["fst_id", "state"]), "subsets")
    finals = sets.select("fst_id", "state", F.explode("subset").alias("m")).select("fst_id", "state", F.col("m.q").alias("q"), F.col("m.r").alias("r"))
    finals = finals.join(fst.states.filter("final_weight is not null").select("fst_id", F.col("state").alias("q"), "final_weight"), ["fst_id", "q"])
    finals = finals.groupBy("fst_id", "state").agg(plus(F.col("r") + F.col("final_weight")).alias("final_weight"))
    states = sets.select("fst_id", "state").join(finals, ["fst_id", "state"], "left")
    out_arcs = reduce(DataFrame.unionByName, made).select("fst_id", F.col("state").alias("src"), F.col("label").alias("ilabel"), F.col("label").alias("olabel"), "weight", F.col("next").alias("dst")) if made else fst.arcs.limit(0)
    start = first.select("fst_id", F.col("state").alias("start"))
    meta = fst.meta.select("fst_id").join(start, "fst_id", "left")
    return fst.with_(meta=meta, states=states, arcs=out_arcs).renumber().cut("determinize")


def minimize(fst: Fst, max_rounds: int = 100_000) -> Fst:
    """Merges states with equal finality and equal arcs into equal classes; takes a deterministic machine.

    Classes are refined until their number stays: a state's new class is a hash of its class, its finality and its
    sorted arcs with the classes they lead to. Weights are compared exactly and not pushed.
    """
    cls = hold(fst.states.select("fst_id", "state", F.xxhash64(F.coalesce("final_weight", F.lit(float("inf")))).alias("c")), "classes")
    count = cls.select("fst_id", "c").distinct().count()
    for _ in range(max_rounds):
        to = cls.select("fst_id", F.col("state").alias("dst"), F.col("c").alias("to"))
        out = fst.arcs.join(to, ["fst_id", "dst"]).groupBy("fst_id", F.col("src").alias("state")).agg(F.sort_array(F.collect_list(F.struct("ilabel", "olabel", "weight", "to"))).alias("sig"))
        old, cls = cls, hold(cls.join(out, ["fst_id", "state"], "left").select("fst_id", "state", F.xxhash64("c", "sig").alias("c")), "classes")
        now = cls.select("fst_id", "c").distinct().count()
        discard(old)
        if now == count:
            break
        count = now
    to = cls.groupBy("fst_id", "c").agg(F.min("state").alias("to"))
    return fst.remap(cls.join(to, ["fst_id", "c"]).select("fst_id", "state", "to")).renumber().cut("minimize")


def encode(fst: Fst) -> Fst:
    """Label pairs as single labels: both 32-bit labels side by side in one 64-bit number, so that no table is needed."""
    pair = F.shiftleft("ilabel", 32).bitwiseOR(F.col("olabel"))
    return fst.with_(arcs=fst.arcs.select("fst_id", "src", pair.alias("ilabel"), pair.alias("olabel"), "weight", "dst"))


def decode(fst: Fst) -> Fst:
    i, o = F.shiftrightunsigned("ilabel", 32), F.col("ilabel").bitwiseAND(F.lit(MAX_LABEL).cast("long"))
    return fst.with_(arcs=fst.arcs.select("fst_id", "src", i.alias("ilabel"), o.alias("olabel"), "weight", "dst"))


def optimize(fst: Fst) -> Fst:
    """Epsilon removal, determinization (of label pairs for transducers), minimization and trimming."""
    fst = rm_epsilon(fst)
    if empty(fst.arcs.filter("ilabel <> olabel")):
        return connect(minimize(determinize(fst)))
    return decode(connect(minimize(determinize(encode(fst)))))
