"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

Documents with equal shingle sets are one class from the start. A class has a signature of BANDS x ROWS minima; two
classes that agree in all minima of some band are candidates. A candidate pair's signatures are compared BATCH
minima at a time; with a uniform prior on the similarity, the pair is dropped as soon as the posterior probability
that it reaches the threshold is below `miss`. What survives is confirmed on the full shingle sets, in whole numbers.
A pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6.

Only components are asked for, so not every pair of a large bucket has to be looked at. In a round, each bucket that
still holds several components sends its members to one hub (another one in each round), and each member is confirmed
against the hub most like it. After that, the members of buckets that still hold several components are packed into
blocks of bounded size, near ones together. Two blocks that meet in a bucket are one unit of work, which makes the same
comparison for all pairs between different components that share a band, confirms what survives, and gives links only.
So no pair that could still join two components is left out, and no pair is a row unless it is a candidate of a hub.

No bucket, class or component is collected anywhere: all are joins and aggregations, with tables written to the shared
folder between rounds. Class ids are 64-bit hashes of the shingle set, so that of n different sets two are taken for one
with probability n^2 / 2^65 (3 percent at 10^9), without a comparison of their members; every other link is confirmed.

Defined results: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text with fewer words than a shingle is one
shingle; a null or wordless text has no shingles and is linked with nothing; rows of one id are documents of their
own, with the component of their text; null ids have no number of their own, so a component of null ids only is null;
a text of any length counts as a whole and is hashed in parts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textbytes import ODD, TABLE, lean, mixed, pieces
from weftline.session import arrow_rows, discard, materialise, ship_by_value, text_batches

ship_by_value(__name__)

BANDS, ROWS, BATCH = 32, 5, 32
_random = np.random.Generator(np.random.PCG64(20240602))
_A = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_P = int(ODD[30])
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_P), run(pow(_P, -1, 2**64))


LONG = 1 << 19  # bytes of a text that are hashed at a time


def _word_hashes(total: np.ndarray, first: np.ndarray, last: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of words from their first to their last byte, but for their length; total are sums of byte values times powers."""
    return (total[last + 1] - total[first]) * down[first]


def _ended(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mixed(raw + length.astype(np.uint64) * ODD[31])


def _words_of_long(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length, LONG bytes at a time; a word that a part ends in is carried on."""
    out, raw, length = [], np.uint64(0), 0
    for at in range(0, len(data), LONG):
        part = data[at : at + LONG]
        n, space = len(part), _space[part]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        total = np.r_[np.uint64(0), np.cumsum(TABLE[_lower[part]] * up[:n], dtype=np.uint64)]
        v, m = _word_hashes(total, first, last, down), last - first + 1
        if length and len(first) and first[0] == 0:
            v[:1] = raw + v[:1] * np.uint64(pow(_P, length, 2**64))
            m[0] += length
        elif length:
            out.append(_ended(np.array([raw]), np.array([length])))
        raw, length = np.uint64(0), 0
        if len(last) and last[-1] == n - 1:
            raw, length, v, m = v[-1], int(m[-1]), v[:-1], m[:-1]
        out.append(_ended(v, m))
    if length:
        out.append(_ended(np.array([raw]), np.array([length])))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingles(w: np.ndarray, words: int) -> np.ndarray:
    """A hash of each `words` words in a row; there are at least so many."""
    n = len(w) - words + 1
    full = w[:n] * ODD[32]
    for i in range(1, words):
        full = full + w[i : n + i] * ODD[32 + i]
    return mixed(full)


def _short(w: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle has, as one shingle."""
    return mixed(np.uint64(len(w) * int(ODD[50]) % 2**64) + (w * ODD[32 : 32 + len(w)]).sum(keepdims=True))


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of every whole text; what is held grows with the number of its words."""
    up, down = _powers(LONG + 1)  # made here, as constants of this module would be sent with every function
    for data, offsets, rows, _ in pieces(column):
        n = len(data)
        if n > LONG:
            for i, row in enumerate(rows):  # a long text is a piece of its own
                w = _words_of_long(data[offsets[i] : offsets[i + 1]], up, down)
                yield int(row), np.unique(_shingles(w, words)) if len(w) >= words else _short(w) if len(w) else np.empty(0, np.uint64)
            continue
        if not n:
            yield from ((int(r), np.empty(0, np.uint64)) for r in rows)
            continue
        space = _space[data]
        begins = ~space
        begins[1:] &= space[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] = ~space[inner]
        ends = ~space  # the last byte of each word
        ends[:-1] &= space[1:]
        ends[inner[inner > 0] - 1] = ~space[inner[inner > 0] - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[_lower[data]] * up[:n], out=total[1:])
        w = _ended(_word_hashes(total, first, last, down), last - first + 1)
        bounds = np.searchsorted(first, offsets)
        full = _shingles(w, words) if len(w) >= words else np.zeros(0, np.uint64)
        for i, row in enumerate(rows):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= words:
                yield int(row), np.unique(full[lo : hi - words + 1])
            elif hi > lo:
                yield int(row), _short(w[lo:hi])
            else:
                yield int(row), np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        v = x[at : at + 4096, None] ^ _B
        v *= _A
        np.minimum(best, v.min(axis=0), out=best)
    return best


def class_id(shingles: np.ndarray) -> int:
    """A hash of the set: the sum of its hashed members, hashed with their number."""
    total = mixed(shingles * ODD[40]).sum(dtype=np.uint64, keepdims=True)
    total += np.uint64(len(shingles) * int(ODD[41]) % 2**64)
    return int(mixed(total).view(np.int64)[0])


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])
    for batch in batches:
        ids, hashes, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        for row, s in shingle_sets(batch.column(1), words):
            id_ = ids[row]
            out.append((id_, hashes[row], len(s), class_id(s) if len(s) else (id_ or 0) * 7046029254386353131 % 2**63, signature(s).tobytes() if len(s) else None))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mixed(np.arange(BANDS, dtype=np.uint64) * ODD[42] + ODD[43])
    for batch in batches:
        nodes = np.asarray(batch.column(0), dtype=np.int64)
        if not len(nodes):
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(nodes), BANDS, ROWS).astype(np.uint64)
        key = mixed((sig * ODD[44 : 44 + ROWS]).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
        yield pa.RecordBatch.from_pydict({"key": key.ravel(), "node": np.repeat(nodes, BANDS)})


def _keep_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, shingle set), for rows whose text is the node's."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])
    for batch in batches:
        nodes, out, size = batch.column(0).to_pylist(), [], 0
        for row, s in shingle_sets(batch.column(1), words):
            if len(s) and class_id(s) == nodes[row]:
                out.append({"node": nodes[row], "members": s.tobytes()})
                size += len(s)
            if size > 500_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each number of compared minima, how many must agree so that the similarity may reach the threshold.

    The similarity's posterior after m of n agree is Beta(1 + m, 1 + n - m); its upper tail is summed on a fine grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                break
        out.append((n, m))
    return out


def _compare(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(a, b, signatures) -> the pairs that survive all batches, with the number of equal minima."""
    for batch in batches:
        k = batch.num_rows
        if not k:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(k, BANDS * ROWS) for i in (2, 3))
        alive, equal, done = np.arange(k), np.zeros(k, np.int64), 0
        for n, least in steps:
            equal[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
            alive, done = alive[equal[alive] >= least], n
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(equal[alive])], names=["a", "b", "equal"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sets) -> the pairs that are similar."""
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        at = pa.array([i for i in range(batch.num_rows) if similar(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (one, two)), percent)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int]], percent: int) -> Iterator[pa.RecordBatch]:
    """(block x, block y, same) -> links between different components of their members.

    Pairs share a band and survive the sequential comparison; those already joined by a link of this unit are skipped.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            same = batch.column(2)[row].as_py()
            x, y = (batch.column(i)[row].as_py() for i in (0, 1))
            root: dict[int, int] = {}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            sig_x, sig_y = (np.frombuffer(b"".join(m["sig"] for m in z), np.uint32).reshape(len(z), BANDS * ROWS) for z in (x, y))
            comp_x, comp_y = (np.array([m["comp"] for m in z]) for z in (x, y))
            sets_x, sets_y = ([np.frombuffer(m["members"], np.uint64) for m in z] for z in (x, y))
            out = []
            for lo in range(0, len(x), 32):
                equal = sig_x[lo : lo + 32, None, :] == sig_y[None]
                alive = comp_x[lo : lo + 32, None] != comp_y[None]
                if same:
                    alive &= np.arange(lo, lo + len(equal))[:, None] < np.arange(len(y))[None]
                alive &= equal.reshape(*equal.shape[:2], BANDS, ROWS).all(axis=3).any(axis=2)
                count = np.zeros(alive.shape, np.int64)
                done = 0
                for n, least in steps:
                    count += equal[:, :, done:n].sum(axis=2)
                    alive &= count >= least
                    done = n
                i, j = np.nonzero(alive)
                for k in np.argsort(-count[i, j], kind="stable"):
                    a, b = lo + int(i[k]), int(j[k])
                    c, d = top(int(comp_x[a])), top(int(comp_y[b]))
                    if c != d and similar(sets_x[a], sets_y[b], percent):
                        root[c] = d
                        out.append((x[a]["node"], y[b]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (a, b), for nodes that have edges.

    Each round takes the smallest label among neighbours, then the label's own label, until no label changes.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = materialise(step.join(jump, "label", "left").select("node", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("moved")), "labels")
        moved = step.filter("moved").limit(1).count()
        discard(label)
        label = step.select("node", "label")
        label._weftline_path = step._weftline_path
        if not moved:
            discard(both)
            return label


BLOCK, BLOCK_BYTES = 256, 2_000_000  # classes and bytes of a block, about


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-5, hub_rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, node (class of equal shingle sets) and component_id (smallest id reachable) of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    signed = materialise(hashed.mapInArrow(lambda b: lean(_sign(b, words)), "id long, hash long, n long, node long, sig binary"), "signed")
    # rep is the class's smallest id; where is a row whose text stands for the class
    classes = materialise(signed.filter("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct("hash", "id")).alias("where"), F.first("sig").alias("sig")), "classes")
    rows = classes.select("node", "sig").mapInArrow(lambda b: lean(_bands(b)), "key long, node long")
    shared = rows.groupBy("key").count().filter("count > 1").select("key")
    members = materialise(rows.join(shared, "key"), "members")
    sigs = materialise(classes.join(members.select("node").distinct(), "node", "left_semi"), "candidates")
    wanted = sigs.select("node", F.col("where.hash").alias("hash"), F.col("where.id").alias("id"))
    sets = hashed.join(wanted, (hashed["hash"] == wanted["hash"]) & hashed["id"].eqNullSafe(wanted["id"])).select("node", "text")
    sets = materialise(sets.mapInArrow(lambda b: lean(_keep_sets(b, words)), "node long, members binary").dropDuplicates(["node"]), "sets")
    steps = least_matches(percent / 100, miss)

    def survivors(pairs: DataFrame) -> DataFrame:
        one, two = (sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lambda b: lean(_compare(b, steps)), "a long, b long, equal long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(c), F.col("members").alias(f"members_{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "members_a", "members_b").mapInArrow(lambda b: lean(_confirm(b, percent)), "a long, b long")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after links (a, b) between classes."""
        of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).filter("a <> b")
        label = components(edges).select(F.col("node").alias("comp"), "label")
        return materialise(comp.join(label, "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")), "components")

    def still_mixed(comp: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """Members of buckets that hold several components, with their bucket's smallest node and its hub of this turn, and how many rows these are.

        A bucket of any size is summed up in parts before the shuffle. The sums are written first, so that the join knows
        their size: it needs no shuffle of the members, or is split where a bucket is large.
        """
        placed = members.join(comp, "node")
        hub = F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn)))
        sums = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("low"), hub.alias("hub"))
        sums = materialise(sums.filter("lo < hi").select("key", "low", "hub"), "buckets")
        placed = materialise(placed.join(sums, "key"), "mixed")
        discard(sums)
        return placed, placed.count()

    def all_between(placed: DataFrame) -> DataFrame:
        """Links between components that share a bucket, by blocks."""
        home = placed.groupBy("node").agg(F.first("comp").alias("comp"), F.min("low").alias("home"))
        home = home.join(sets, "node").join(sigs.select("node", "sig"), "node")
        size = home.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("members")) / BLOCK_BYTES)).alias("n"))
        block = F.xxhash64("home", F.pmod(F.xxhash64("node", F.lit("block")), F.col("n")))
        home = home.join(size, "home").withColumn("block", block)
        packs = home.groupBy("block").agg(F.collect_list(F.struct("node", "comp", "sig", "members")).alias("pack"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        packs = materialise(packs, "packs")
        where = packs.select("block", "low", "high", F.explode("pack.node").alias("node")).join(placed.select("key", "node"), "node").select("key", "block", "low", "high").distinct()
        one, two = (where.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")]) for s in "xy")
        units = one.join(two, "key").filter("block_x <= block_y and least(low_x, low_y) < greatest(high_x, high_y)").select("block_x", "block_y").distinct()
        of = lambda s: packs.select(F.col("block").alias(f"block_{s}"), F.col("pack").alias(f"pack_{s}"))
        units = units.join(of("x"), "block_x").join(of("y"), "block_y").select("pack_x", "pack_y", (F.col("block_x") == F.col("block_y")).alias("same"))
        with arrow_rows(spark, 4):
            links = materialise(units.mapInArrow(lambda b: lean(_meet(b, steps, percent)), "a long, b long"), "links")
        discard(packs)
        return links

    comp = sigs.select("node", F.col("node").alias("comp"))
    placed, left = still_mixed(comp, 0)
    for i in range(hub_rounds):
        if not left:
            break
        pairs = placed.filter("comp <> hub.comp").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        best = survivors(pairs).groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
        with arrow_rows(spark, 128):
            links = materialise(confirmed(best), "links")
        if not links.count():
            break
        old, comp = comp, joined(comp, links)
        discard(placed, links, old)
        placed, left = still_mixed(comp, i + 1)
    if left:
        comp = joined(comp, all_between(placed))
    ids = classes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = ids.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = ids.join(smallest, "comp").select("node", "component_id")
    out = signed.select("id", "hash", "n", "node").join(ids, "node", "left")
    out = out.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = materialise(out, "near-duplicates")
    discard(signed, classes, members, sigs, sets, placed, comp)
    return out


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first document of each component; rows that repeat the first one in id and text go too."""
    names = docs.columns
    found = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col)
    first = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__hash", F.xxhash64(text_col))
    named = hashed.join(first, (hashed[id_col] == first["__id"]) & (hashed["__hash"] == first["__hash"]), "left_semi").dropDuplicates([id_col, "__hash"])
    nameless = hashed.filter(F.col(id_col).isNull()).join(first.filter("__id is null"), "__hash", "left_semi").dropDuplicates(["__hash"])
    return named.select(*names).unionByName(nameless.select(*names))
