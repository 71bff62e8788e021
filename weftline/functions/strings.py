"""Strings as linear machines and back, for whole columns."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import Fst
from weftline.session import hold, ship_by_value, text_batches

ship_by_value(__name__)


def byte_labels(text: Column) -> Column:
    """Labels (byte + 1) of a string or binary column, as an array."""
    # as Latin-1, every byte is one character
    return F.transform(F.split(F.decode(text.cast("binary"), "ISO-8859-1"), ""), lambda x: F.ascii(x).cast("long") + 1)


def _linear(labels: DataFrame) -> Fst:
    """(fst_id, labels: array of (ilabel, olabel), n: their number) -> one chain each."""
    n = F.col("n").cast("long")
    meta = labels.select("fst_id", F.lit(0).cast("long").alias("start"))
    states = labels.select("fst_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("state"), n.alias("n"))
    states = states.select("fst_id", "state", F.when(F.col("state") == F.col("n"), F.lit(0.0)).alias("final_weight"))
    arcs = labels.select("fst_id", F.posexplode("labels").alias("p", "l"))
    arcs = arcs.select("fst_id", F.col("p").cast("long").alias("src"), "l.ilabel", "l.olabel", F.lit(0.0).alias("weight"), (F.col("p") + 1).cast("long").alias("dst"))
    return Fst(meta, states, arcs, dense=True, chains=labels.select("fst_id", n.alias("n"), "labels"))


def compile_strings(df: DataFrame, id_col: str, text_col: str) -> Fst:
    """A linear acceptor for each row; null texts have no machine."""
    some = F.octet_length(text_col) > 0
    x = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("fst_id"), F.when(some, byte_labels(F.col(text_col))).otherwise(F.array().cast("array<bigint>")).alias("b"), F.octet_length(text_col).alias("n"))
    fst = _linear(x.select("fst_id", F.transform("b", lambda v: F.struct(v.alias("ilabel"), v.alias("olabel"))).alias("labels"), "n"))
    # arcs are exploded before they are labelled: functions over arrays cost more than the rest; as Latin-1, every byte is one character
    bytes_ = F.posexplode(F.split(F.decode(F.col(text_col).cast("binary"), "ISO-8859-1"), "")).alias("p", "c")
    arcs = df.filter(some).select(F.col(id_col).cast("long").alias("fst_id"), bytes_)
    label = F.ascii("c").cast("long") + 1
    arcs = arcs.select("fst_id", F.col("p").cast("long").alias("src"), label.alias("ilabel"), label.alias("olabel"), F.lit(0.0).alias("weight"), (F.col("p") + 1).cast("long").alias("dst"))
    return replace(fst, arcs=arcs)


def compile_pairs(df: DataFrame, id_col: str, one: str, other: str) -> Fst:
    """A linear transducer for each row; the shorter string is filled up with epsilons. Rows with a null have no machine."""
    labels = lambda c: F.when(F.octet_length(c) > 0, byte_labels(F.col(c))).otherwise(F.array().cast("array<bigint>"))
    n = F.greatest(F.octet_length(one), F.octet_length(other))
    x = df.filter(F.col(one).isNotNull() & F.col(other).isNotNull()).select(F.col(id_col).cast("long").alias("fst_id"), labels(one).alias("a"), labels(other).alias("b"), n.alias("n"))
    zero = F.lit(0).cast("long")
    return _linear(x.select("fst_id", F.zip_with("a", "b", lambda v, w: F.struct(F.coalesce(v, zero).alias("ilabel"), F.coalesce(w, zero).alias("olabel"))).alias("labels"), "n"))


def _spelled(labels: np.ndarray, shift: int) -> str | None:
    """The string of a tape's labels, epsilons left out; None where they are no bytes or no UTF-8."""
    labels = labels[labels != 0] - shift
    if len(labels) and (labels.min() < 0 or labels.max() > 255):
        return None
    try:
        return labels.astype(np.uint8).tobytes().decode()
    except UnicodeDecodeError:
        return None


def _tape(shift: int):
    def run(tapes: pa.Array) -> pa.Array:
        return pa.array([_spelled(np.asarray(x.values, np.int64), shift) if x.is_valid else None for x in tapes], pa.string())

    return F.arrow_udf(run, "string")


def _walk(shift: int):
    def run(starts: pa.Array, arcs: pa.Array, finals: pa.Array) -> pa.Array:
        """Follows each machine's arcs from its start to a final state without arcs."""
        out: list[str | None] = []
        for start, row, ends in zip(starts.to_pylist(), arcs, finals.to_pylist(), strict=True):
            src, label, dst = (np.asarray(row.values.field(i), np.int64) if row.is_valid else np.empty(0, np.int64) for i in range(3))
            text = None
            if start is not None:
                n, ends = len(src), set(ends or ())
                if n and src[0] == start and (dst[:-1] == src[1:]).all() and (np.diff(src) > 0).all() and int(dst[-1]) in ends and not (src == dst[-1]).any():
                    text = label  # the arcs are in the chain's order
                else:
                    to: dict[int, tuple[int, int] | None] = {}
                    for s, l, d in zip(src.tolist(), label.tolist(), dst.tolist(), strict=True):
                        to[s] = None if s in to else (l, d)  # None: a branch
                    at, tape, left = start, [], len(to) + 1
                    while left and to.get(at):
                        l, at = to[at]
                        tape.append(l)
                        left -= 1
                    text = np.array(tape, np.int64) if left and at not in to and at in ends else None
            out.append(None if text is None else _spelled(text, shift))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def print_strings(fst: Fst, side: str = "output", shift: int = 1) -> DataFrame:
    """fst_id, text of each machine's tape, read along its arcs from the start whatever the states' numbers.

    Null unless every state on the way has one arc until a final state that has none, and where the bytes are no
    UTF-8. States off the way, final or not, don't matter. A machine's arcs have to fit in a row, as its text does.
    """
    label = "olabel" if side == "output" else "ilabel"
    text_batches(fst.spark)
    if fst.chains is not None:  # their labels are arrays already, in the order of the arcs
        return fst.chains.select("fst_id", _tape(shift)(F.col(f"labels.{label}")).alias("text"))
    # a machine's parts meet in one aggregation: exploded rows are many more than Spark expects, and a join may broadcast them
    arc = F.struct("src", F.col(label).alias("l"), "dst")
    rows = fst.arcs.select("fst_id", arc.alias("arc"), *_nulls("end", "start", "known"))
    rows = rows.unionByName(fst.states.filter("final_weight is not null").select("fst_id", F.col("state").alias("end")), allowMissingColumns=True)
    rows = rows.unionByName(fst.meta.select("fst_id", "start", F.lit(1).cast("long").alias("known")), allowMissingColumns=True)
    x = rows.groupBy("fst_id").agg(F.array_sort(F.collect_list("arc")).alias("arcs"), F.collect_list("end").alias("ends"), F.max("start").alias("start"), F.max("known").alias("known"))
    return x.filter("known = 1").select("fst_id", _walk(shift)(F.col("start"), F.col("arcs"), F.col("ends")).alias("text"))


def _nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("long").alias(n) for n in names]


def any_of_strings(df: DataFrame, id_col: str, text_col: str, weight_col: str | None = None, fst_id: int = 0) -> Fst:
    """One machine that accepts each row's string with the row's weight: a start with an epsilon to a chain for each row."""
    fst = compile_strings(df, id_col, text_col)
    width = fst.states.agg(F.max("state")).first()[0]
    width = 1 + (width or 0)
    at = lambda c: (F.col("fst_id") * width + F.col(c) + 1).alias(c)
    one = F.lit(fst_id).cast("long").alias("fst_id")
    zero = F.lit(0).cast("long")
    states = fst.states
    if weight_col:
        own = df.select(F.col(id_col).cast("long").alias("fst_id"), F.col(weight_col).cast("double").alias("__w"))
        states = states.join(own, "fst_id").select("fst_id", "state", F.when(F.col("final_weight").isNotNull(), F.col("__w")).alias("final_weight"))
    spark = df.sparkSession
    first = spark.range(1).select(one, zero.alias("state"), F.lit(None).cast("double").alias("final_weight"))
    out_states = first.unionByName(states.select(at("state"), "final_weight").select(one, "state", "final_weight"))
    enter = fst.meta.select(zero.alias("src"), zero.alias("ilabel"), zero.alias("olabel"), F.lit(0.0).alias("weight"), at("start")).withColumnRenamed("start", "dst")
    arcs = fst.arcs.select(at("src"), "ilabel", "olabel", "weight", at("dst")).unionByName(enter).select(one, "src", "ilabel", "olabel", "weight", "dst")
    return Fst(spark.range(1).select(one, zero.alias("start")), out_states, arcs)


def trie(df: DataFrame, text_col: str, weight_col: str | None = None, fst_id: int = 0) -> Fst:
    """A deterministic acceptor of a column's strings, of any number: a state for each prefix, made by one explode.

    Of a string that comes twice the smaller weight stays. Prefixes are told apart by a 64-bit hash with their length
    and then numbered; n prefixes share one by chance with probability n^2 / 2^64.
    """
    w = F.lit(0.0) if weight_col is None else F.col(weight_col).cast("double")
    words = df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("b"), w.alias("w"))
    hashed = lambda n: F.xxhash64(F.substr("b", F.lit(1), n), n)
    n = F.octet_length("b")
    steps = words.select("b", F.explode(F.sequence(F.lit(0), n)).alias("n")).filter(F.col("n") < F.octet_length("b"))
    label = F.conv(F.hex(F.substr("b", F.col("n") + 1, F.lit(1))), 16, 10).cast("long") + 1
    arcs = steps.select(hashed(F.col("n")).alias("src"), label.alias("l"), hashed(F.col("n") + 1).alias("dst")).distinct()
    root = F.xxhash64(F.lit(b""), F.lit(0))
    ends = words.groupBy(hashed(n).alias("state")).agg(F.min("w").alias("final_weight"))
    spark = df.sparkSession
    one = F.lit(fst_id).cast("long").alias("fst_id")
    arcs = hold(arcs.select(one, "src", F.col("l").alias("ilabel"), F.col("l").alias("olabel"), F.lit(0.0).alias("weight"), "dst"), "trie")
    states = spark.range(1).select(root.alias("state")).unionByName(arcs.select(F.col("dst").alias("state"))).join(ends, "state", "left")
    return Fst(spark.range(1).select(one, root.alias("start")), states.select(one, "state", "final_weight"), arcs).renumber().cut("trie")
