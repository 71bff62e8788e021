"""Composition of many small machines with one shared machine, inside the workers.

The shared machine is frozen: its arcs are indexed by state and input label and sent to the workers, after a check of
its size. Each machine of the batch is one packed row, and its product is built, or only searched, where the row is: no
rounds and no shuffle but the packing. For machines that are large themselves operators.compose goes round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions.machine import Machine
from weftline.model import Fst, same_space
from weftline.plans.packed import ARC_FIELDS, freeze
from weftline.semiring import INF
from weftline.session import materialise, ship_by_value, text_batches

ship_by_value(__name__)

State = tuple[int, int, int]
CELLS = 50_000  # states and arcs that a worker holds before it hands them on
_arc = pa.struct([("src", pa.int64()), ("ilabel", pa.int64()), ("olabel", pa.int64()), ("weight", pa.float64()), ("dst", pa.int64())])
ROW = "fst_id long, start long, finals array<double>, arcs array<struct<src:long,ilabel:long,olabel:long,weight:double,dst:long>>"
_ROW = pa.schema([("fst_id", pa.int64()), ("start", pa.int64()), ("finals", pa.list_(pa.float64())), ("arcs", pa.list_(_arc))])


class Product:
    """The product of a packed row and a shared machine; arcs of a product state are made when they are asked for.

    A state is (s1, s2, f); f lets one order of epsilon moves through, as in operators.compose.
    """

    def __init__(self, row: dict, shared: Machine, index: list[dict[int, list]]):
        self.row, self.shared, self.index = row, shared, index

    def arcs(self, at: State) -> Iterator[tuple[int, int, float, State]]:
        s1, s2, f = at
        off, by_label = self.row["offsets"], self.index[s2]
        for i, o, w, d in self.row["arcs"][off[s1] : off[s1 + 1]]:
            if o or f == 0:
                for o2, w2, d2 in by_label.get(o, ()):
                    yield i, o2, w + w2, (d, d2, 0)
            if not o and f != 1:
                yield i, 0, w, (d, s2, 2)
        if f != 2:
            for o2, w2, d2 in by_label.get(0, ()):
                yield 0, o2, w2, (s1, d2, 1)

    def final(self, at: State) -> float:
        return self.row["finals"][at[0]] + self.shared.finals[at[1]]


Found = tuple[list[float], list[tuple[int, int, int, float, int]]]  # final weights, arcs as (src, ilabel, olabel, weight, dst)


def _whole(p: Product, start: State) -> Found:
    """Every state that can be reached, numbered in the order in which it is met, and all arcs."""
    number, todo, arcs = {start: 0}, [start], []
    for src, at in enumerate(todo):  # grows
        for i, o, w, to in p.arcs(at):
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            arcs.append((src, i, o, w, number[to]))
    return [p.final(s) for s in todo], arcs


def _best(p: Product, start: State, falls: bool) -> Found | None:
    """The best path as a chain; only states are visited that no better way to a final state rules out.

    Ties go to fewer arcs, then to the smaller state. falls: there are negative weights, so nothing is ruled out.
    """
    best: dict[State, tuple[float, int]] = {start: (0.0, 0)}
    back: dict[State, tuple[State, int, int, float]] = {}
    queue, end = [(0.0, 0, start)], (INF, 0, start)
    limit = 3 * len(p.row["finals"]) * p.shared.num_states
    while queue:
        w, hops, at = heappop(queue)
        if (w, hops) > best[at]:
            continue
        if not falls and w > end[0]:
            break
        if hops > limit:
            raise ValueError(f"machine {p.row['fst_id']}: a negative cycle")
        end = min(end, (w + p.final(at), hops, at))
        for i, o, v, to in p.arcs(at):
            way = (w + v, hops + 1)
            if v != INF and way < best.get(to, (INF, 0)):
                best[to], back[to] = way, (at, i, o, v)
                heappush(queue, (*way, to))
    if end[0] == INF:
        return None
    at, arcs = end[2], []
    while at in back and at != start:
        at, i, o, v = back[at]
        arcs.append((i, o, v))
    arcs.reverse()
    return [INF] * len(arcs) + [p.final(end[2])], [(k, i, o, v, k + 1) for k, (i, o, v) in enumerate(arcs)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The packed machines of a batch, one at a time; arcs are tuples."""
    finals, offsets, arcs = (batch.column(c) for c in ("finals", "offsets", "arcs"))
    for k, (fst_id, start) in enumerate(zip(batch.column("fst_id").to_pylist(), batch.column("start").to_pylist(), strict=True)):
        row = arcs[k].values
        columns = [row.field(c).to_pylist() for c in ARC_FIELDS]
        yield {"fst_id": fst_id, "start": start, "finals": finals[k].as_py(), "offsets": offsets[k].as_py(), "arcs": list(zip(*columns, strict=True))}


def _batch(found: list[tuple[int, Found | None]]) -> pa.RecordBatch:
    ends = [f[0] if f else [] for _, f in found]
    ways = [f[1] if f else [] for _, f in found]
    offsets = lambda x: pa.array([0, *accumulate(map(len, x))], pa.int32())
    columns = list(zip(*chain.from_iterable(ways), strict=True)) or [()] * len(_arc)
    arcs = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _arc, strict=True)], fields=list(_arc))
    finals = pa.array(list(chain.from_iterable(ends)), pa.float64())
    starts = pa.array([0 if f else None for _, f in found], pa.int64())
    return pa.record_batch([pa.array([i for i, _ in found], pa.int64()), starts, pa.ListArray.from_arrays(offsets(ends), finals), pa.ListArray.from_arrays(offsets(ways), arcs)], schema=_ROW)


def _apply(a: Fst, b: Fst | Machine, work: Callable[[Product, State], Found | None], tag: str) -> Fst:
    if isinstance(b, Fst):
        same_space(a, b)
        b = Machine.of(b)
    index: list[dict[int, list]] = []
    for arcs in b.arcs:
        by_label: dict[int, list] = {}
        for i, o, w, d in arcs:
            by_label.setdefault(i, []).append((o, w, d))
        index.append(by_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, Found | None]] = []
        cells = 0
        for batch in batches:
            for r in _rows(batch):
                found = work(Product(r, b, index), (r["start"], b.start, 0)) if r["start"] is not None and b.start is not None else None
                done.append((r["fst_id"], found))
                cells += 1 + (len(found[0]) + len(found[1]) if found else 0)
                if cells >= CELLS:
                    yield _batch(done)
                    done, cells = [], 0
        if done:
            yield _batch(done)

    text_batches(a.spark)  # a machine is a large row
    rows = materialise(freeze(a).mapInArrow(run, ROW), tag)  # written once: all parts are read from it
    states = rows.select("fst_id", F.posexplode("finals").alias("state", "w"))
    states = states.select("fst_id", F.col("state").cast("long").alias("state"), F.when(F.abs("w") != INF, F.col("w")).alias("final_weight"))
    return a.with_(meta=rows.select("fst_id", "start"), states=states, arcs=rows.select("fst_id", F.explode("arcs").alias("a")).select("fst_id", "a.*"))


def compose_shared(a: Fst, b: Fst | Machine) -> Fst:
    """Every machine of a composed with the one machine b; states are numbered in the order in which they are met."""
    return _apply(a, b, _whole, "shared")


def compose_shortest_path(a: Fst, b: Fst | Machine, n: int = 1) -> Fst:
    """The best path of each product as a chain with the arcs' own weights, without making the product."""
    if n == 0:
        return a.with_(meta=a.meta.withColumn("start", F.lit(None).cast("long")), states=a.states.limit(0), arcs=a.arcs.limit(0))
    if n != 1:
        raise NotImplementedError("one best path only")
    falls = a.arcs.filter("weight < 0").limit(1).count() > 0 or a.states.filter("final_weight < 0").limit(1).count() > 0
    shared = Machine.of(b) if isinstance(b, Fst) else b
    if isinstance(b, Fst):
        same_space(a, b)
    falls = falls or any(w < 0 for x in shared.arcs for _, _, w, _ in x) or any(w < 0 for w in shared.finals)
    return _apply(a, shared, lambda p, start: _best(p, start, falls), "best")


def chain_weights(chains: Fst):
    """fst_id, weight: the sum over each chain's arcs and its final weight."""
    parts = chains.arcs.select("fst_id", "weight").unionByName(chains.states.filter("final_weight is not null").select("fst_id", F.col("final_weight").alias("weight")))
    return parts.groupBy("fst_id").agg(F.sum("weight").alias("weight"))
