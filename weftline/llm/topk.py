"""Exact top-k inner products with a pivot table (distances to many pivots, computed once per vector).

The distances of a query q and a vector y to all pivots bound the distance of q and y from below. Each pivot p alone
gives |q - y| >= |d(q, p) - d(y, p)|; together they give the largest bound that follows from them: distances and norms
say where q and y lie in the space that the pivots span, and how long the rest of each is, and

    |q - y|^2 >= |q' - y'|^2 + (|q''| - |y''|)^2,    so    q.y <= q'.y' + |q''| |y''|,

where ' is the part in that space and '' the rest. It is never below the bound of a single pivot. Candidates are
evaluated in the order of that bound, and a query stops when the bound of the next candidate is below the k-th best
score that is known: everything left is eliminated.

Layout: vectors are packed into blocks of at most block_rows rows, queries likewise. In a first round each query block
meets a few vector blocks (the square root of their number), and the k-th best score found there goes along with the
query: no other block needs to look at candidates below it. Then every query block meets every vector block, as the
product of the two tables: each task reads a part of each, so no copies of either are shuffled, broadcast or sent to the
driver. A task keeps k rows a query, whose k-th score raises the bound for its next block, and a last window per query
merges the tasks' rows. Pivots are a bounded number of vectors (three quarters of the dimension, unless said otherwise),
chosen far from the span of those before among the first n_seeds rows in the order of a hash, so what the driver and
tasks receive has a fixed size.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do those of which a
component times 1024 is no finite number; a score beyond the range of a long is given as the nearest long, and ranks
as that; shorter vectors count as padded with zeros; rows without id take no part; equal rows are all candidates, and a
query's own id is no candidate; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import arrow_rows, discard, materialise, ship_by_value

ship_by_value(__name__)

SCALE = 1024
STEP = 32  # candidates that are evaluated between two looks at the bound
HUGE = 1e120  # components beyond this make bounds overflow, so all candidates are evaluated
_MIN, _MAX = -(2**63), 2**63 - 1
QUERY_PART = 64  # query blocks that a task holds at most
TASKS = 10_000  # of the product of both tables; the driver keeps a record of each
BLOCK = "slot int, part int, ids binary, x binary, d binary"
FOUND = "query_id long, vec_id long, score long, evaluated long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors floor(SCALE * x) as rows of float64; exact below 2^53."""
    out = np.zeros((len(column), dim))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(column) and (lengths == dim).all():
        out[:] = flat.reshape(len(column), dim)
    else:
        at = 0
        for i, n in enumerate(lengths):
            out[i, :n] = flat[at : at + n]
            at += n
    return np.floor(out * SCALE)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))


def choose_pivots(seeds: np.ndarray, n: int) -> np.ndarray:
    """At most n rows: each is the farthest from the span of those chosen before."""
    seeds = seeds[np.abs(seeds).max(axis=1, initial=0) < HUGE] if len(seeds) else seeds
    rest, chosen = seeds.copy(), []
    while len(chosen) < n and len(rest):
        size = (rest * rest).sum(1)
        i = int(np.argmax(size))
        if size[i] <= 1e-6 * (seeds[i] * seeds[i]).sum() or not size[i]:
            break
        chosen.append(i)
        unit = rest[i] / np.sqrt(size[i])
        rest -= np.outer(rest @ unit, unit)
        rest -= np.outer(rest @ unit, unit)  # once more, for rounding
    return seeds[chosen]


class Places:
    """Where vectors lie in the pivots' span, read off their distances."""

    def __init__(self, pivots: np.ndarray):
        self.norms = (pivots * pivots).sum(1)
        self.back = np.linalg.inv(np.linalg.qr(pivots.T)[1]) if len(pivots) else np.zeros((0, 0))

    def of(self, d: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span, and the length of the rest."""
        inside = ((norms[:, None] + self.norms[None, :] - d * d) / 2) @ self.back
        return inside, np.sqrt(np.maximum(norms - (inside * inside).sum(1), 0))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(x).max(initial=0)
    return next((x.astype(t).tobytes() for t in (np.int16, np.int32) if most <= np.iinfo(t).max), x.tobytes())


def pack(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(slot, id, vector) -> one row a block: slot, its number there, ids, vectors, pivot distances as bytes."""
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = np.asarray(part.column(1), dtype=np.int64)
            x = _matrix(part.column(2), dim)
            yield pa.RecordBatch.from_pydict({"slot": part.column(0)[:1], "part": pa.array([n], pa.int32()), "ids": [ids.tobytes()], "x": [_narrow(x)], "d": [_distances(x, pivots).tobytes()]})
            n += 1


class Block:
    """Rows of a packed block and where they lie."""

    def __init__(self, ids: bytes, x: bytes, d: bytes, dim: int, places: Places):
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(x, {2: np.int16, 4: np.int32, 8: np.float64}[len(x) // (n * dim)]).reshape(n, dim).astype(np.float64)
        self.most = np.abs(self.x).max(initial=0)
        if self.most < HUGE:
            self.norms = (self.x * self.x).sum(1)
            self.inside, self.rest = places.of(np.frombuffer(d).reshape(n, len(places.norms)), self.norms)

    def bounds(self, other: Block) -> np.ndarray:
        """Upper bounds of the inner products with another block's rows."""
        if max(self.most, other.most) >= HUGE:
            return np.full((len(self.ids), len(other.ids)), np.inf)
        slack = (self.norms[:, None] + other.norms[None, :]) * 1e-9 + 1  # covers the rounding of distances and coordinates
        return np.maximum(self.inside @ other.inside.T + np.outer(self.rest, other.rest) + slack, _MIN)  # no score is given as less


class Asked:
    """A query block with the best rows of the vector blocks it has met."""

    def __init__(self, row: dict, dim: int, places: Places):
        self.packed = {c: row[c] for c in ("q_slot", "q_part", "q_ids", "q_x", "q_d")}
        self.block = Block(row["q_ids"], row["q_x"], row["q_d"], dim, places)
        n = len(self.block.ids)
        self.floors = np.frombuffer(row["q_floor"], np.int64) if row.get("q_floor") else np.full(n, _MIN)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n  # scores from the best, ids
        self.evaluated = [0] * n

    def meet(self, block: Block, k: int) -> None:
        bounds = self.block.bounds(block)
        exact = bool(block.x.shape[1] * max(self.block.most, block.most) ** 2 < 2**52)
        for i, qid in enumerate(self.block.ids):
            bound = np.where(block.ids == qid, -np.inf, bounds[i])
            self.found[i], n = best(self.block.x[i], block, bound, k, exact, int(self.floors[i]), *self.found[i])
            self.evaluated[i] += n


def best(q: np.ndarray, block: Block, bound: np.ndarray, k: int, exact: bool, floor: int, scores: np.ndarray, ids: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The k best of the scores and ids so far and those of a block that reach floor (ties: smaller id), and how many were evaluated."""
    if len(scores) == k:
        floor = max(floor, int(scores[-1]))
    order = np.flatnonzero(bound >= floor)
    order = order[np.argsort(-bound[order], kind="stable")]
    at = 0
    while at < len(order) and bound[order[at]] >= floor:
        rows = order[at : at + STEP]
        if exact:
            more = (block.x[rows] @ q).astype(np.int64)
        else:
            more = np.array([min(_MAX, max(_MIN, sum(int(a) * int(b) for a, b in zip(block.x[r], q, strict=True)))) for r in rows], np.int64)
        at += len(rows)
        good = more >= floor
        if good.any():
            scores, ids = np.concatenate([scores, more[good]]), np.concatenate([ids, block.ids[rows[good]]])
            first = np.lexsort((ids, ~scores))[:k]
            scores, ids = scores[first], ids[first]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
    return (scores, ids), at


def meet(batches: Iterator[pa.RecordBatch], dim: int, places: Places, k: int) -> list[Asked]:
    """All query blocks of a task, after they have met all its vector blocks."""
    asked: dict[tuple[int, int], Asked] = {}
    at = block = None
    for batch in batches:
        for row in batch.to_pylist():
            if at != (row["slot"], row["part"]):
                at, block = (row["slot"], row["part"]), Block(row["ids"], row["x"], row["d"], dim, places)
            key = (row["q_slot"], row["q_part"])
            if key not in asked:
                asked[key] = Asked(row, dim, places)
            asked[key].meet(block, k)
    return list(asked.values())


def first_round(batches: Iterator[pa.RecordBatch], dim: int, places: Places, k: int) -> Iterator[pa.RecordBatch]:
    """Query blocks with the score that each query's k-th best of a few vector blocks has."""
    for a in meet(batches, dim, places, k):
        floors = np.array([scores[-1] if len(scores) == k else _MIN for scores, _ in a.found], np.int64)
        ints = {c: pa.array([a.packed[c]], pa.int32()) for c in ("q_slot", "q_part")}
        yield pa.RecordBatch.from_pydict({**ints, **{c: [a.packed[c]] for c in ("q_ids", "q_x", "q_d")}, "q_floor": [floors.tobytes()]})


def search(batches: Iterator[pa.RecordBatch], dim: int, places: Places, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's best rows; where there is none, a row without vec_id says how many were evaluated."""
    for a in meet(batches, dim, places, k):
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "evaluated": []}
        for qid, (scores, ids), n in zip(a.block.ids.tolist(), a.found, a.evaluated, strict=True):
            rows = max(len(ids), min(n, 1))
            out["query_id"] += [qid] * rows
            out["vec_id"] += ids.tolist() or [None] * rows
            out["score"] += scores.tolist() or [None] * rows
            out["evaluated"] += [n, *[0] * (rows - 1)][:rows]
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))


def seed_rows(rows: DataFrame, n: int, n_seeds: int) -> list:
    """The first n_seeds of n rows in the order of a hash of their ids, put together in a task and not by the driver."""
    hashed = rows.select("v", "id", F.xxhash64("id").alias("h"))
    # about four times as many rows have hashes that low, unless ids repeat
    some = hashed.filter(F.col("h") < _MIN + (2**66 * n_seeds) // n) if n > 4 * n_seeds else hashed
    for df in (some, hashed):
        found = df.orderBy("h", "id").limit(n_seeds).repartition(1).collect()
        if len(found) >= min(n, n_seeds):
            break
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, n_pivots: int | None = None, n_seeds: int = 512, block_rows: int = 4096, query_rows: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query row; evaluated: of all the query's candidates."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == F.lit(float("inf"))))
    kept = F.col(vector_col) if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else v  # half the bytes of doubles
    sound_rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), kept.alias("v"), is_query.alias("is_query"))
    shape = sound_rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    dim = max(1, shape["dim"])
    seeds = seed_rows(sound_rows, shape["n"], n_seeds)
    pivots = choose_pivots(_matrix(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), dim), n_pivots or max(1, 3 * dim // 4))
    places = Places(pivots)
    n_blocks, q_blocks = -(-shape["n"] // block_rows), max(1, -(-shape["q"] // query_rows))

    def packed(df: DataFrame, n: int, rows: int) -> DataFrame:
        """Blocks; slot is the partition that a block comes from, so every slot has its own blocks."""
        dealt = df.repartitionById(n, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
        return dealt.select(F.spark_partition_id().alias("slot"), "id", "v").mapInArrow(lambda b: pack(b, pivots, dim, rows), BLOCK)

    blocks = materialise(packed(sound_rows.select("id", "v"), n_blocks, block_rows), "vector-blocks")
    asked = materialise(packed(sound_rows.filter("is_query").select("id", "v").distinct(), q_blocks, query_rows), "query-blocks")
    q = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    slots = [r["slot"] for r in blocks.select("slot").distinct().orderBy("slot").limit(math.isqrt(n_blocks)).collect()]
    few = blocks.filter(F.col("slot").isin(slots) & (F.col("part") == 0)).coalesce(1)
    q_parts = max(-(-q_blocks // QUERY_PART), min(q_blocks, spark.sparkContext.defaultParallelism))

    def met(some: DataFrame, queries: DataFrame, n: int) -> DataFrame:
        """Each vector block with each query block; the hint keeps Spark from sending a side to the driver."""
        return some.crossJoin(queries.repartitionById(n, F.pmod("q_slot", F.lit(n)).cast("int")).hint("shuffle_replicate_nl"))

    with arrow_rows(spark, 4):  # a row is two blocks
        looked = met(few, q, q_blocks).mapInArrow(lambda b: first_round(b, dim, places, k), "q_slot int, q_part int, q_ids binary, q_x binary, q_d binary, q_floor binary")
        known = materialise(looked, "query-floors")
        found = materialise(met(blocks.coalesce(max(1, TASKS // q_parts)), known, q_parts).mapInArrow(lambda b: search(b, dim, places, k), FOUND), "found")
    discard(blocks, asked, known)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    total = found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))
    ranked = found.filter("vec_id IS NOT NULL").drop("evaluated").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(total, "query_id").select("query_id", "rank", "vec_id", "score", "evaluated")
