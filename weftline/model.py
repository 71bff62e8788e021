"""Batches of weighted finite-state machines as three DataFrames.

meta has a row for each machine (fst_id, start), states one for each state (fst_id, state, final_weight, null where the
state isn't final), arcs one for each arc (fst_id, src, ilabel, olabel, weight, dst). Label 0 is epsilon. Arcs may have a
column paths besides, how many equal arcs each stands for (operators.compose.merge_parallel). All frames are immutable,
so every operation returns a new batch; machines of a batch never see each other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.prefix import numbered
from weftline.semiring import INF, SEMIRINGS, Tropical, is_zero
from weftline.session import hold, row_count

META = "fst_id long, start long"
STATES = "fst_id long, state long, final_weight double"
ARCS = "fst_id long, src long, ilabel long, olabel long, weight double, dst long"
EPSILON = 0
CELLS = 4096
MAX_LABEL = 2**32 - 1


class InvalidMachine(ValueError):
    pass


@dataclass(frozen=True)
class Fst:
    meta: DataFrame
    states: DataFrame
    arcs: DataFrame
    semiring: type[Tropical] = Tropical
    encoding: str = "byte_plus_one"
    dense: bool = False  # whether states are known to be numbered 0, 1, ... in each machine
    chains: DataFrame | None = None  # of a batch of chains: fst_id, the number n of arcs and their labels as an array, so that counting, packing and printing need no arcs

    @property
    def spark(self) -> SparkSession:
        return self.meta.sparkSession

    def with_(self, **changes) -> Fst:
        if {"meta", "states", "arcs"} & set(changes):
            changes.setdefault("chains", None)
            changes.setdefault("dense", False)
        return replace(self, **changes)

    def cut(self, tag: str = "fst") -> Fst:
        """The same batch with its lineage cut, so that plans don't grow with the number of operations."""
        return self.with_(meta=hold(self.meta, f"{tag}-meta"), states=hold(self.states, f"{tag}-states"), arcs=hold(self.arcs, f"{tag}-arcs"), dense=self.dense)

    # accessors

    def sizes(self) -> DataFrame:
        """fst_id, num_states, num_arcs, num_finals."""
        if self.chains is not None:
            return self.chains.select("fst_id", (F.col("n") + 1).alias("num_states"), F.col("n").alias("num_arcs"), F.lit(1).cast("long").alias("num_finals"))
        s = self.states.groupBy("fst_id").agg(F.count(F.lit(1)).alias("num_states"), F.count("final_weight").alias("num_finals"))
        a = self.arcs.groupBy("fst_id").agg(F.count(F.lit(1)).alias("num_arcs"))
        out = self.meta.select("fst_id").join(s, "fst_id", "left").join(a, "fst_id", "left")
        return out.select("fst_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_states", "num_arcs", "num_finals")])

    def final_weight(self, state: int) -> DataFrame:
        """fst_id, final_weight: infinity where the state isn't final."""
        return self.states.filter(F.col("state") == state).select("fst_id", F.coalesce("final_weight", F.lit(INF)).alias("final_weight"))

    def sorted_arcs(self) -> DataFrame:
        """Arcs with their place among those of their state: by ilabel, olabel, weight, dst."""
        order = Window.partitionBy("fst_id", "src").orderBy("ilabel", "olabel", "weight", "dst")
        return self.arcs.withColumn("ord", F.row_number().over(order) - 1)

    def arcs_by_ilabel(self, label: int, state: int | None = None) -> DataFrame:
        out = self.arcs.filter(F.col("ilabel") == label)
        return out if state is None else out.filter(F.col("src") == state)

    def find_arc(self, state: int, label: int) -> DataFrame:
        """The first arc of each machine from state with that input label."""
        first = self.arcs_by_ilabel(label, state).groupBy("fst_id").agg(F.min(F.struct("olabel", "weight", "dst")).alias("a"))
        return first.select("fst_id", F.lit(state).cast("long").alias("src"), F.lit(label).cast("long").alias("ilabel"), "a.*")

    # editing

    def set_final(self, state: int, weight: float = 0.0) -> Fst:
        return self.with_(states=self.states.withColumn("final_weight", F.when(F.col("state") == state, F.lit(float(weight))).otherwise(F.col("final_weight"))))

    def set_start(self, state: int) -> Fst:
        return self.with_(meta=self.meta.withColumn("start", F.lit(state).cast("long")))

    def delete_arcs(self, state: int) -> Fst:
        return self.with_(arcs=self.arcs.filter(F.col("src") != state))

    def delete_states(self) -> Fst:
        return self.with_(meta=self.meta.withColumn("start", F.lit(None).cast("long")), states=self.states.limit(0), arcs=self.arcs.limit(0))

    def remap(self, mapping: DataFrame) -> Fst:
        """Merges or drops states by mapping (fst_id, state, to); to null drops. Of merged states the smallest one's finality and arcs stay."""
        kept = mapping.filter(F.col("to").isNotNull())
        chosen = kept.groupBy("fst_id", "to").agg(F.min("state").alias("state"))
        states = self.states.join(chosen, ["fst_id", "state"]).select("fst_id", F.col("to").alias("state"), "final_weight")
        src = chosen.select("fst_id", F.col("state").alias("src"), F.col("to").alias("new_src"))
        dst = kept.select("fst_id", F.col("state").alias("dst"), F.col("to").alias("new_dst"))
        many = [c for c in ("paths",) if c in self.arcs.columns]
        arcs = self.arcs.join(src, ["fst_id", "src"]).join(dst, ["fst_id", "dst"]).select("fst_id", F.col("new_src").alias("src"), "ilabel", "olabel", "weight", F.col("new_dst").alias("dst"), *many)
        meta = self.meta.join(kept.select("fst_id", F.col("state").alias("start"), "to"), ["fst_id", "start"], "left").select("fst_id", F.col("to").alias("start"))
        return self.with_(meta=meta, states=states, arcs=arcs)

    def renumber(self) -> Fst:
        """States as 0, 1, ... in ascending order of their ids."""
        return self if self.dense else self.remap(hold(ranked(self.states), "ranks")).with_(dense=True)

    # checks

    def problems(self) -> DataFrame:
        """fst_id and what is wrong with it; no rows for sound machines."""
        have = self.states.select("fst_id", F.col("state").alias("s"))
        start = self.meta.filter("start is not null").select("fst_id", F.col("start").alias("s")).join(have, ["fst_id", "s"], "left_anti").select("fst_id", F.lit("start is no state").alias("problem"))
        ends = self.arcs.select("fst_id", F.explode(F.array("src", "dst")).alias("s")).distinct().join(have, ["fst_id", "s"], "left_anti").select("fst_id", F.lit("arc without state").alias("problem"))
        labels = self.arcs.filter(f"ilabel < 0 or olabel < 0 or ilabel > {MAX_LABEL} or olabel > {MAX_LABEL}").select("fst_id", F.lit("label out of range").alias("problem"))
        return start.unionByName(ends).unionByName(labels).distinct()

    def validate(self) -> Fst:
        if bad := self.problems().take(1):
            raise InvalidMachine(f"machine {bad[0]['fst_id']}: {bad[0]['problem']}")
        return self

    def properties(self) -> DataFrame:
        """acceptor, epsilon_free, deterministic (on input labels), unweighted for each machine."""
        many = self.arcs.groupBy("fst_id", "src", "ilabel").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("ilabel") == F.col("olabel")).alias("same"), F.bool_and((F.col("ilabel") != 0) | (F.col("olabel") != 0)).alias("no_eps"), F.bool_and(F.col("weight") == 0).alias("unit"), F.bool_and(F.col("ilabel") != 0).alias("reads"))
        a = many.groupBy("fst_id").agg(F.bool_and("same").alias("acceptor"), F.bool_and("no_eps").alias("epsilon_free"), (F.bool_and("reads") & (F.max("n") <= 1)).alias("deterministic"), F.bool_and("unit").alias("unit"))
        s = self.states.groupBy("fst_id").agg(F.bool_and(F.coalesce(F.col("final_weight") == 0, F.lit(True))).alias("unit_finals"))
        out = self.meta.select("fst_id").join(a, "fst_id", "left").join(s, "fst_id", "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(True))
        return out.select("fst_id", *[yes(c).alias(c) for c in ("acceptor", "epsilon_free", "deterministic")], (yes("unit") & yes("unit_finals")).alias("unweighted"))

    # the language

    def language(self, max_arcs: int | None = None) -> DataFrame:
        """fst_id, ilabels, olabels, weight, paths: what the paths relate, epsilons left out.

        Without max_arcs all paths are followed to their end, and a machine with a cycle that its start reaches is an
        error, as its paths have no end. With max_arcs, longer paths are left out, as the caller asked for.
        """
        finals = self.states.filter(F.col("final_weight").isNotNull() & ~is_zero(F.col("final_weight"))).select("fst_id", "state", "final_weight")
        none = F.array().cast("array<long>")
        now = self.meta.filter("start is not null").select("fst_id", F.col("start").alias("state"), none.alias("ilabels"), none.alias("olabels"), F.lit(0.0).alias("w"), F.lit(1).cast("long").alias("paths"))
        arcs = self.arcs.filter(~is_zero(F.col("weight")))
        arcs = arcs.withColumnRenamed("paths", "each") if "paths" in arcs.columns else arcs.withColumn("each", F.lit(1).cast("long"))
        add = lambda old, new: F.when(F.col(new) == 0, F.col(old)).otherwise(F.concat(old, F.array(new)))
        every, rounds, most = [now], 0, None
        while max_arcs is None or rounds < max_arcs:
            now = now.join(arcs, (now["fst_id"] == arcs["fst_id"]) & (now["state"] == arcs["src"])).select(now["fst_id"], F.col("dst").alias("state"), add("ilabels", "ilabel").alias("ilabels"), add("olabels", "olabel").alias("olabels"), (F.col("w") + F.col("weight")).alias("w"), (F.col("paths") * F.col("each")).alias("paths"))
            now = hold(now.groupBy("fst_id", "state", "ilabels", "olabels").agg(self.semiring.plus("w").alias("w"), F.sum("paths").alias("paths")), "paths", now)
            if not row_count(now):
                break
            rounds += 1
            if max_arcs is None:
                # a path with as many arcs as its machine has states has been in some state twice
                most = self.states.groupBy("fst_id").count().agg(F.max("count")).first()[0] if most is None else most
                if rounds >= most:
                    raise InvalidMachine(f"paths go on after {rounds} arcs, so there is a cycle: say how many arcs a path may have")
            every.append(now)
        ends = reduce(DataFrame.unionByName, every).join(finals, ["fst_id", "state"]).withColumn("w", F.col("w") + F.col("final_weight"))
        return ends.groupBy("fst_id", "ilabels", "olabels").agg(self.semiring.plus("w").alias("weight"), F.sum("paths").alias("paths"))


def ranked(states: DataFrame) -> DataFrame:
    """fst_id, state, to: each state's place among its machine's, from 0, in the order of their ids.

    A machine's states are numbered in up to CELLS parts of equal width, so that no machine is one window.
    """
    states = states.select("fst_id", "state")
    span = states.groupBy("fst_id").agg(F.min("state").alias("lo"), F.max("state").alias("hi"))
    # halves first: the distance of two ids may be more than a long holds
    half = lambda c: F.shiftright(c, 1)
    cell = F.floor((half("state") - half("lo")) / (F.floor((half("hi") - half("lo")) / F.lit(CELLS)) + 1)).cast("long")
    placed = states.join(span, "fst_id").select("fst_id", "state", cell.alias("cell"))
    return numbered(placed, ["fst_id"], "cell", [F.col("state")], "to").select("fst_id", "state", "to")


def label_text(labels: str, shift: int = 1):
    """The string that a list of labels spells in bytes; null for labels that are no byte."""
    hexes = F.transform(F.col(labels), lambda x: F.lpad(F.hex(x - shift), 2, "0"))
    return F.when(F.forall(F.col(labels), lambda x: (x >= shift) & (x < 256 + shift)), F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8"))


def frame(spark: SparkSession, fst_id: int, start: int | None, finals: dict[int, float], arcs: list[tuple], n_states: int | None = None, semiring: str = "tropical", encoding: str = "byte_plus_one") -> Fst:
    """A batch of one machine from literals; arcs are (src, ilabel, olabel, weight, dst)."""
    n = n_states if n_states is not None else 1 + max([-1, *(x for a in arcs for x in (a[0], a[4])), *finals, *([] if start is None else [start])])
    bad = [x for x in [*finals, *(y for a in arcs for y in (a[0], a[4])), *([] if start is None else [start])] if not 0 <= x < n]
    if bad:
        raise InvalidMachine(f"state {bad[0]} of {n}")
    meta = spark.createDataFrame([(fst_id, start)], META)
    states = spark.createDataFrame([(fst_id, s, None if s not in finals or abs(finals[s]) == INF else float(finals[s])) for s in range(n)], STATES)
    rows = spark.createDataFrame([(fst_id, int(s), int(i), int(o), float(w), int(d)) for s, i, o, w, d in arcs], ARCS)
    return Fst(meta, states, rows, SEMIRINGS[semiring], encoding)


def empty(spark: SparkSession, fst_id: int = 0) -> Fst:
    return frame(spark, fst_id, None, {}, [], 0)


def batch(machines: list[Fst]) -> Fst:
    """Several batches with different ids as one."""
    first, *rest = machines
    for m in rest:
        same_space(first, m)
        first = first.with_(meta=first.meta.unionByName(m.meta), states=first.states.unionByName(m.states), arcs=first.arcs.unionByName(m.arcs))
    return first


def same_space(a: Fst, b: Fst) -> None:
    if a.encoding != b.encoding or a.semiring is not b.semiring:
        raise InvalidMachine(f"{a.encoding}/{a.semiring.name} and {b.encoding}/{b.semiring.name} machines don't combine")
