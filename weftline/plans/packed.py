"""Machines packed for lookups: arrays of arcs by state, sorted by input label, and their binary form."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.machine import Machine
from weftline.model import Fst
from weftline.semiring import INF
from weftline.session import ship_by_value

ship_by_value(__name__)

# fixed values: the binary layout, little-endian
MAGIC, VERSION, NO_STATE = 0x46535421, 1, 0xFFFFFFFF
HEADER, HEADER_BYTES = "<IHBBIIII", 24
STATE = np.dtype([("offset", "<u4"), ("n", "<u4"), ("final", "<f8")])
ARC = np.dtype([("ilabel", "<u4"), ("olabel", "<u4"), ("weight", "<f8"), ("dst", "<u4"), ("pad", "<u4")])


class InvalidFormat(ValueError):
    pass


class Packed:
    def __init__(self, start: int | None, states: np.ndarray, arcs: np.ndarray, semiring: int = 0):
        self.start, self.states, self.arcs, self.semiring = start, states, arcs, semiring

    @staticmethod
    def of(machine: Machine, semiring: int = 0) -> Packed:
        rows = [sorted(a) for a in machine.arcs]
        states = np.zeros(len(rows), STATE)
        states["n"] = [len(a) for a in rows]
        states["offset"] = np.r_[0, np.cumsum(states["n"])[:-1]] if len(rows) else 0
        states["final"] = machine.finals
        arcs = np.array([(*a, 0) for x in rows for a in x], ARC)
        return Packed(machine.start, states, arcs, semiring)

    def machine(self) -> Machine:
        out = Machine()
        out.add_states(len(self.states))
        out.finals = [float(x) for x in self.states["final"]]
        out.arcs = [[(int(a["ilabel"]), int(a["olabel"]), float(a["weight"]), int(a["dst"])) for a in self.arcs_of(s)] for s in range(len(self.states))]
        out.start = self.start
        return out

    def arcs_of(self, state: int) -> np.ndarray:
        s = self.states[state]
        return self.arcs[s["offset"] : s["offset"] + s["n"]]

    def arcs_by_ilabel(self, state: int, label: int) -> np.ndarray:
        a = self.arcs_of(state)
        lo, hi = np.searchsorted(a["ilabel"], [label, label + 1])
        return a[lo:hi]

    def find_arc(self, state: int, label: int):
        a = self.arcs_by_ilabel(state, label)
        return a[0] if len(a) else None

    def to_bytes(self) -> bytes:
        head = struct.pack(HEADER, MAGIC, VERSION, self.semiring, 0, len(self.states), len(self.arcs), NO_STATE if self.start is None else self.start, 0)
        return head + self.states.tobytes() + self.arcs.tobytes()

    @staticmethod
    def of_row(start: int | None, finals: np.ndarray, offsets: np.ndarray, arcs: dict[str, np.ndarray], semiring: int = 0) -> Packed:
        """From a row of freeze(), without an object for each arc; arcs of a state are sorted already."""
        states, rows = np.zeros(len(finals), STATE), np.zeros(len(arcs["dst"]), ARC)
        states["n"], states["offset"], states["final"] = np.diff(offsets), offsets[: len(finals)], finals
        for c in ARC_FIELDS:
            rows[c] = arcs[c]
        return Packed(start, states, rows, semiring)

    @staticmethod
    def from_bytes(data: bytes) -> Packed:
        if len(data) < HEADER_BYTES:
            raise InvalidFormat("shorter than a header")
        magic, version, semiring, _, n, m, start, _ = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION or semiring > 1:
            raise InvalidFormat("not a machine of this version")
        if len(data) != HEADER_BYTES + n * STATE.itemsize + m * ARC.itemsize:
            raise InvalidFormat("size doesn't fit the header")
        states = np.frombuffer(data, STATE, n, HEADER_BYTES)
        arcs = np.frombuffer(data, ARC, m, HEADER_BYTES + n * STATE.itemsize)
        if start != NO_STATE and start >= n:
            raise InvalidFormat("start is no state")
        if (states["offset"].astype(np.int64) + states["n"] > m).any() or (arcs["dst"] >= n).any():
            raise InvalidFormat("arc range or target out of range")
        for s in states:
            if (np.diff(arcs["ilabel"][s["offset"] : s["offset"] + s["n"]].astype(np.int64)) < 0).any():
                raise InvalidFormat("arcs aren't sorted")
        return Packed(None if start == NO_STATE else start, states, arcs, semiring)


ARC_FIELDS = "ilabel", "olabel", "weight", "dst"
ARC_ARRAY = "array<struct<ilabel:long,olabel:long,weight:double,dst:int>>"
PACKED = "fst_id long, start int, finals array<double>, offsets array<int>, arcs array<struct<ilabel:long,olabel:long,weight:double,dst:int>>"


def freeze(fst: Fst) -> DataFrame:
    """A row for each machine: start, final weights by state, where each state's arcs begin, and sorted arcs.

    A packed machine is one row, so its arcs have to fit in a worker.
    """
    if fst.chains is not None:
        return _freeze_chains(fst.chains)
    fst = fst.renumber()
    # parts meet in aggregations: exploded rows are many more than Spark expects, and a join may broadcast them
    counts = fst.states.select("fst_id", F.col("state").alias("src"), F.coalesce("final_weight", F.lit(INF)).alias("f"), F.lit(0).cast("long").alias("n"))
    counts = counts.unionByName(fst.arcs.select("fst_id", "src", F.lit(None).cast("double").alias("f"), F.lit(1).cast("long").alias("n")))
    counts = counts.groupBy("fst_id", "src").agg(F.min("f").alias("f"), F.sum("n").alias("n")).filter("f is not null")
    sizes = counts.select("fst_id", "src", "f", F.sum("n").over(Window.partitionBy("fst_id").orderBy("src")).cast("int").alias("upto"))
    rows = sizes.select("fst_id", F.struct("src", "f", "upto").alias("s"))
    rows = rows.unionByName(fst.arcs.select("fst_id", F.struct("src", "ilabel", "olabel", "weight", F.col("dst").cast("int").alias("dst")).alias("a")), allowMissingColumns=True)
    rows = rows.unionByName(fst.meta.select("fst_id", F.col("start").cast("int").alias("start"), F.lit(True).alias("known")), allowMissingColumns=True)
    x = rows.groupBy("fst_id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("a")).alias("a"), F.max("start").alias("start"), F.max("known").alias("known")).filter("known")
    offsets = F.concat(F.array(F.lit(0)), F.col("s.upto"))
    arcs = F.arrays_zip(*[F.col(f"a.{c}").alias(c) for c in ARC_FIELDS])
    return x.select("fst_id", "start", F.col("s.f").alias("finals"), offsets.alias("offsets"), arcs.cast(ARC_ARRAY).alias("arcs"))


def _freeze_chains(chains: DataFrame) -> DataFrame:
    """A chain's row follows from its labels: a state's only arc leads to the next one, and the last one is final."""
    n = F.col("n").cast("int")
    zero, empty = F.lit(0), F.array().cast("array<int>")
    finals = F.concat(F.array_repeat(F.lit(INF), n), F.array(F.lit(0.0)))
    offsets = F.concat(F.sequence(zero, n), F.array(n))
    to = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(empty)
    arcs = F.arrays_zip(F.col("labels.ilabel").alias("ilabel"), F.col("labels.olabel").alias("olabel"), F.array_repeat(F.lit(0.0), n).alias("weight"), to.alias("dst"))
    return chains.select("fst_id", zero.alias("start"), finals.alias("finals"), offsets.alias("offsets"), arcs.cast(ARC_ARRAY).alias("arcs"))


def thaw(packed: DataFrame, like: Fst) -> Fst:
    """The batch that freeze() packed."""
    meta = packed.select("fst_id", F.col("start").cast("long").alias("start"))
    states = packed.select("fst_id", F.posexplode("finals").alias("state", "w")).select("fst_id", F.col("state").cast("long").alias("state"), F.when(F.col("w") != INF, F.col("w")).alias("final_weight"))
    # each state's arcs as an array of their own, so that an arc needs no search for its state
    by_state = F.transform(F.sequence(F.lit(1), F.size("finals")), lambda i: F.slice("arcs", F.get("offsets", i - 1) + 1, F.get("offsets", i) - F.get("offsets", i - 1)))
    arcs = packed.filter(F.size("finals") > 0).select("fst_id", F.posexplode(by_state).alias("src", "out")).select("fst_id", F.col("src").cast("long").alias("src"), F.explode("out").alias("a"))
    arcs = arcs.select("fst_id", "src", "a.ilabel", "a.olabel", "a.weight", F.col("a.dst").cast("long").alias("dst"))
    return like.with_(meta=meta, states=states, arcs=arcs)
