"""Repeated byte strings across documents, found over a prefix-free parse whose suffixes are put in corpus order.

A rolling hash of 32 bytes triggers phrases. In each string of LENGTH (100) bytes the smallest of its 32-byte hashes,
the last one if several are equal, is its trigger, which its content alone decides. A phrase is a run of places whose
100-byte strings have the same trigger; its text reaches to the end of the last of them. So phrases cover every
place, and equal 100-byte strings lie at the same distance from equal triggers: a string can be repeated only inside
phrases of one trigger. The dictionary has each different phrase of a trigger once; the parse is what remains of the
corpus: (trigger, phrase, document, place) rows. A document is an id and the hash of its text.

Corpus order is needed to a depth of 100 bytes, and every suffix is that long inside its phrase. So what follows a
phrase never decides, and the order is made of two parts:

1. parse: its rows are sorted by (trigger, phrase, document, place). All but the first occurrence of a phrase repeat
   earlier text as a whole; the first one stands for the phrase in the dictionary.
2. dictionary: the phrases of a trigger, with their bytes, meet in one place, and their suffixes of 100 bytes and more
   are sorted by their bytes and, where 100 bytes agree, by the first occurrence's document and place: a suffix array to
   depth 100 merged with the parse's order. All but the first of a run of agreeing suffixes repeat earlier text.
   Two phrases can share a string only on a side of the trigger on which the next 32 bytes agree, as a string reaches
   34 bytes beyond its trigger on one side at least; only such sides of phrases go to the dictionary.
3. the places found become spans of each document.

Rows are sorted inside hash partitions and read as a stream; equal phrases inside one piece of input are merged before
the shuffle, which takes the heat off frequent passages. The suffixes of one trigger's phrases are sorted in memory, up
to GROUP phrases. The phrases of a trigger with more are dealt out by their 100-byte strings, a row of bytes each, so
that no worker holds them all; that is the same comparison, and by count takes up to 69 rows of 100 bytes for such a
phrase, before compression, where others take one row.

Two different phrases of one trigger count as equal only if 88 bits of two independent hashes agree; strings of the
dictionary are compared by their bytes.

Defined results: a null text is empty; texts below 100 bytes keep everything; a very long text is parsed in parts that
overlap by 99 bytes, with the same result; a null id is smaller than all others;
rows of one id (null too) with one text count as the same document, so that equal places in them are not each other's
repetition; rows of one id with different texts are documents of their own, told apart and ordered by a 64-bit hash of
the text; an empty table gives no rows; other columns are ignored, or kept by without_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.textbytes import ODD, TABLE, byte_hashes, lean, mixed, pieces, sliding_min, window_hashes
from weftline.session import discard, materialise, ship_by_value, shuffle_partitions, text_batches

ship_by_value(__name__)

LENGTH, GRAM = 100, 32
SIDE = (LENGTH - GRAM) // 2  # every string holds that many bytes before its trigger, or behind it
NO_ID = -(2**63)
GROUP = 2_000  # phrases of one trigger whose suffixes are sorted in memory, 7 MB of them
PIECE = 1 << 18  # bytes of text that are parsed at a time
CHUNK = 4096  # phrases whose suffixes are sorted at a time, as far as triggers allow
_LOW, _24, _32, _40, _48 = np.uint64(0xFFFFFFFF), *(np.uint64(x) for x in (24, 32, 40, 48))
PARSE = "k1 long, k2 long, sides int, doc long, twin long, at long"
_PARSE = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sides", pa.int32()), *((c, pa.int64()) for c in ("doc", "twin", "at"))])
FOUND = "t long, doc long, twin long, first long, last long, kind int"
_FOUND = pa.schema([*((c, pa.int64()) for c in ("t", "doc", "twin", "first", "last")), ("kind", pa.int32())])
REPEAT, OPEN, SPREAD = 0, 1, 2  # kinds: known to repeat; places whose strings go to the dictionary; the same for a trigger beyond GROUP
PHRASES = "t long, spread boolean, doc long, twin long, at long, data binary"
_PHRASES = pa.schema([("t", pa.int64()), ("spread", pa.bool_()), ("doc", pa.int64()), ("twin", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
SPANS = "doc long, twin long, first long, last long"
_SPANS = pa.schema([(c, pa.int64()) for c in ("doc", "twin", "first", "last")])

# A row of the parse: k1 is 40 bits of the trigger and 24 of the phrase; k2 is 64 bits of the phrase by another hash;
# sides are 16 bits of the 32 bytes before the trigger and 16 of those behind it (0: no string of the phrase holds them).
# at is the place of the first string, the trigger's distance from it, and the number of strings (1 to 69). doc is the
# id, twin the hash of the text. A row with at < 0 is a span that is known to repeat: k2 is its start and -at its end.


def _after(doc: np.ndarray, twin: np.ndarray, place: np.ndarray, doc2: np.ndarray, twin2: np.ndarray, place2: np.ndarray) -> np.ndarray:
    """Which places come after the second ones in the corpus."""
    return (doc > doc2) | ((doc == doc2) & ((twin > twin2) | ((twin == twin2) & (place > place2))))


def _spans(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans that touch; they come by document and start, with ends that don't fall."""
    if not len(doc):
        return doc, twin, start, end
    new = np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > end[:-1])]
    first = np.flatnonzero(new)
    return doc[first], twin[first], start[first], end[np.r_[first[1:] - 1, len(doc) - 1]]


def _emit(k1: np.ndarray, k2: np.ndarray, sides: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one piece: later occurrences of a phrase in it become spans here already."""
    place = at >> 16
    if len(doc) > 1 and _after(doc[:-1], twin[:-1], place[:-1], doc[1:], twin[1:], place[1:]).any():
        order = np.lexsort((place, twin, doc))
        k1, k2, sides, doc, twin, at, place = (x[order] for x in (k1, k2, sides, doc, twin, at, place))
    order = np.lexsort((k2, k1))
    one, two = k1[order], k2[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(order)]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = _after(doc[order], twin[order], place[order], doc[first], twin[first], place[first])
    d, t, s, f = _spans(doc[later], twin[later], place[later], place[later] + (at[later] & 255) + (LENGTH - 1))
    spread = mixed(d.astype(np.uint64) * ODD[10] + s.astype(np.uint64)).view(np.int64)
    keep = ~later
    columns = [np.concatenate(x) for x in ((k1[keep].view(np.int64), spread), (k2[keep].view(np.int64), s), (sides[keep].view(np.int32), np.zeros(len(d), np.int32)), (doc[keep], d), (twin[keep], t), (at[keep], -f))]
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_PARSE)


def _side(h32: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
    """16 bits, none of them 0, of the 32 bytes at the places that count."""
    out = np.zeros(len(place), np.uint32)
    out[there] = np.maximum(h32[place[there]] >> _48, np.uint64(1)).astype(np.uint32)
    return out


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, text) -> phrases. Parts of a very long text are parsed each for itself, which only splits phrases."""
    width = LENGTH - GRAM + 1
    # made in each task: as a constant of this module they would be sent with every function and stay in workers
    powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(PIECE + LENGTH, x, np.uint64)], dtype=np.uint64) for x in (int(ODD[20]), pow(int(ODD[20]), -1, 2**64)))
    for batch in batches:
        ids, twins = np.asarray(batch.column(0).fill_null(NO_ID), dtype=np.int64), np.asarray(batch.column(1), dtype=np.int64)
        for data, offsets, rows, base in pieces(batch.column(2), limit=PIECE, overlap=LENGTH - 1):
            if len(data) < LENGTH:
                continue
            h32, h64, _ = byte_hashes(data)
            w, _ = window_hashes(h64, LENGTH)
            v = (h32 & ~_LOW) | (_LOW - np.arange(len(h32), dtype=np.uint64))
            trigger = (_LOW - (sliding_min(v, width) & _LOW)).astype(np.int64)
            n = len(trigger)  # strings start at 0 .. n - 1
            part = np.repeat(np.arange(len(rows)), np.diff(offsets))[:n]
            valid = np.arange(n) + LENGTH <= offsets[part + 1]
            new = valid.copy()
            new[1:] &= (trigger[1:] != trigger[:-1]) | (part[1:] != part[:-1]) | ~valid[:-1]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            # a phrase ends where the next one starts, or with its part's last string
            last = np.minimum(np.r_[first[1:], n] - 1, offsets[part[first] + 1] - LENGTH)
            run = (last - first + 1).astype(np.int64)
            spot = trigger[first]
            lead = spot - first
            e = mixed(w[first] * ODD[11] + w[last] * ODD[12] + run.astype(np.uint64) * ODD[13] + lead.astype(np.uint64) * ODD[14])
            total = np.r_[np.uint64(0), np.cumsum(TABLE[data ^ np.uint8(0xA5)] * powers[: len(data)], dtype=np.uint64)]
            other = mixed((total[last + LENGTH] - total[first]) * inverse[first] + run.astype(np.uint64) * ODD[15] + lead.astype(np.uint64) * ODD[16])
            sides = (_side(h32, spot - GRAM, lead >= SIDE) << np.uint32(16)) | _side(h32, spot + GRAM, spot - last <= SIDE)
            k1 = ((h32[spot] >> _24) << _24) | (e >> _40)
            p = part[first]
            yield from _emit(k1, other, sides, ids[rows[p]], twins[rows[p]], ((first - offsets[p] + base[p]) << 16) | (lead << 8) | run)


def _packed(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, with their length in front."""
    codec = pa.Codec("zstd", compression_level=3)
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in texts.cast(kind).to_pylist()], pa.binary())


def _unpacked(data: list) -> list:
    codec = pa.Codec("zstd")
    return [None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in data]


def _runs(t: np.ndarray, sides: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray, kind: int = OPEN) -> tuple[np.ndarray, ...]:
    """Which strings of first occurrences may be shared with other phrases of their trigger; rows come by t."""
    if kind == SPREAD:
        before = behind = np.ones(len(t), bool)
    else:
        group = np.cumsum(np.r_[False, t[1:] != t[:-1]]).astype(np.int64)

        def shared(side: np.ndarray) -> np.ndarray:
            _, back, n = np.unique((group << 16) | side, return_inverse=True, return_counts=True)
            return (n[back] > 1) & (side > 0)

        before, behind = shared((sides >> 16) & 0xFFFF), shared(sides & 0xFFFF)
    use = before | behind
    before, behind, t, doc, twin, at = before[use], behind[use], t[use], doc[use], twin[use], at[use]
    place, lead, run = at >> 16, (at >> 8) & 255, at & 255
    middle = place + lead - SIDE  # strings from here reach SIDE bytes behind the trigger, up to here SIDE bytes before it
    first, last = np.where(before, place, np.maximum(place, middle)), np.where(behind, place + run, np.minimum(place + run, middle + 1))
    some = first < last
    return t[some], doc[some], twin[some], first[some], last[some], np.full(int(some.sum()), kind, np.int32)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parse, sorted by (k1, k2, doc, twin, at), as a stream: spans of later occurrences, and first ones for the dictionary.

    Held between batches: the first occurrence of the last phrase, and the first occurrences of the last trigger's
    phrases, up to GROUP.
    """
    last = None  # k1, k2, doc, twin and place of the last phrase's first occurrence
    held = [np.empty(0, np.int64)] * 5
    large = None  # a trigger with more than GROUP phrases

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_FOUND)

    def repeats(doc: np.ndarray, twin: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple:
        return np.zeros(len(doc), np.int64), doc, twin, first, end, np.full(len(doc), REPEAT, np.int32)

    for batch in batches:
        k1, k2, sides, doc, twin, at = (np.asarray(batch.column(i)).astype(np.int64) for i in range(6))
        known = at < 0
        parts = [repeats(doc[known], twin[known], k2[known], -at[known])]
        k1, k2, sides, doc, twin, at = (x[~known] for x in (k1, k2, sides, doc, twin, at))
        n = len(k1)
        if n:
            place = at >> 16
            new = np.r_[last is None or (k1[0], k2[0]) != last[:2], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            source = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            fd, ft, fp = (np.where(source >= 0, x[source], last[i] if last else 0) for i, x in ((2, doc), (3, twin), (4, place)))
            later = _after(doc, twin, place, fd, ft, fp)
            parts.append(repeats(doc[later], twin[later], place[later], place[later] + (at[later] & 255) + (LENGTH - 1)))
            last = (k1[-1], k2[-1], fd[-1], ft[-1], fp[-1])
            t = k1 >> 24
            mine = [np.concatenate(x) for x in zip(held, (x[~later] for x in (t, sides, doc, twin, at)), strict=True)]
            over = (mine[0] == large) if large is not None else np.zeros(len(mine[0]), bool)
            parts.append(_runs(*(x[over] for x in mine), kind=SPREAD))
            mine = [x[~over] for x in mine]
            go_on = mine[0] == t[-1]
            done = [x[~go_on] for x in mine]
            # a trigger that came and went inside this batch may have too many phrases as well
            _, back, size = np.unique(done[0], return_inverse=True, return_counts=True)
            many = size[back] > GROUP if len(back) else np.zeros(0, bool)
            parts += [_runs(*(x[many] for x in done), kind=SPREAD), _runs(*(x[~many] for x in done))]
            held = [x[go_on] for x in mine]
            if len(held[0]) > GROUP:
                large = t[-1]
                parts.append(_runs(*held, kind=SPREAD))
                held = [x[:0] for x in held]
        yield from out(parts)
    yield from out([_runs(*held)])


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, compressed text, open runs of places) -> the dictionary: the bytes of each run, or of each of its strings."""
    for batch in batches:
        runs = batch.column(3)
        offsets, flat = np.asarray(runs.offsets), runs.values
        t, first, last, kind = (np.asarray(flat.field(i)).astype(np.int64) for i in range(4))
        rows: list[tuple] = []
        size = 0
        for i, (doc, twin, packed) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            text = _unpacked([packed])[0] or b""
            for j in range(offsets[i], offsets[i + 1]):
                a, z = int(first[j]), int(last[j])
                if kind[j] == SPREAD:
                    rows += [(t[j], True, doc, twin, p, text[p : p + LENGTH]) for p in range(a, z)]
                    size += (z - a) * LENGTH
                else:
                    rows.append((t[j], False, doc, twin, a, text[a : z + LENGTH - 1]))
                    size += z - a + LENGTH
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _PHRASES, strict=True)], schema=_PHRASES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _PHRASES, strict=True)], schema=_PHRASES)


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of byte strings (one after the other in data) all suffixes of LENGTH and more bytes, sorted by their first LENGTH bytes.

    Returns the string and place of each suffix in that order, and whether it agrees with the one before it in LENGTH
    bytes. Suffixes that agree stay in the order in which their strings came.
    """
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    if not len(row):
        return row, place, np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[offsets[:-1][row] + place]
    strings = np.ascontiguousarray(view).view(f"S{LENGTH}").ravel()  # all are LENGTH long, so padding by zeros changes nothing
    order = np.argsort(strings, kind="stable")
    strings = strings[order]
    return row[order], place[order], np.r_[False, strings[1:] == strings[:-1]]


def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary rows, sorted by (key, doc, twin, at), as a stream -> spans of strings that an earlier place has too.

    Rows of one key are compared with each other. Held are rows of a few keys, CHUNK at least unless there are no more;
    of spread strings, whose key is a hash of their bytes, one of each.
    """
    held: list[tuple] = []  # key, doc, twin, at, data
    seen: dict[bytes, tuple] = {}
    at_key = None

    def sorted_out(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[1:4])  # corpus order, which the suffix array keeps among equal strings
        rows = [r for i, r in enumerate(rows) if not i or r[:4] != rows[i - 1][:4]]  # rows of one id and text come twice
        offsets = np.r_[0, np.cumsum([len(r[4]) for r in rows])]
        row, place, same = suffix_array(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), offsets)
        row, place = row[same], place[same]
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)][: len(row)])
        ends = np.r_[new[1:], len(row)] - 1 if len(new) else new
        for a, z in zip(new, ends, strict=True):
            _, doc, twin, at, _ = rows[row[a]]
            yield doc, twin, at + int(place[a]), at + int(place[z]) + LENGTH

    def out(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans, strict=True)], schema=_SPANS)

    for batch in batches:
        spans: list[tuple] = []
        for key, spread, *where, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if spread:
                if key != at_key:
                    seen, at_key = {}, key
                first = seen.setdefault(data, tuple(where))
                if first != tuple(where):
                    spans.append((*where, where[2] + LENGTH))
                continue
            if len(held) >= CHUNK and key != held[-1][0]:
                spans += sorted_out(held)
                held = []
            held.append((key, *where, data))
        yield from out(spans)
    if held:
        yield from out(list(sorted_out(held)))


def _sorted(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), key).sortWithinPartitions(*order)


def _key(id_col: str, text_col: str) -> list[Column]:
    """A document's id, NO_ID for null, and the hash of its text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col))]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, twin (see _key) and spans: places [first, last) of the text's UTF-8 bytes that repeat earlier text.

    Spans may touch or overlap; documents without any are left out. Rows with the same id and text give each span once.
    """
    text_batches(docs.sparkSession)
    key, twin = _key(id_col, text_col)
    texts = docs.select(key.alias("key"), twin.alias("twin"), F.col(text_col).alias("text"))
    parsed = _sorted(texts.mapInArrow(lambda b: lean(parse(b)), PARSE), F.shiftright("k1", 24), "k1", "k2", "doc", "twin", "at")
    found = materialise(parsed.mapInArrow(lambda b: lean(settle(b)), FOUND), "phrases")
    runs = found.filter(F.col("kind") != REPEAT).groupBy(F.col("doc").alias("key"), "twin").agg(F.collect_set(F.struct("t", "first", "last", "kind")).alias("runs"))
    small = texts.select("key", "twin", F.arrow_udf(_packed, "binary")("text").alias("data"))
    phrases = small.join(runs, ["key", "twin"]).select("key", "twin", "data", "runs").mapInArrow(lambda b: lean(entries(b)), PHRASES)
    # strings of a trigger with too many phrases meet by their bytes' hash, others by their trigger
    phrases = phrases.withColumn("t", F.when(F.col("spread"), F.xxhash64("data")).otherwise(F.col("t")))
    more = _sorted(phrases, F.col("t"), "t", "spread", "doc", "twin", "at").mapInArrow(lambda b: lean(dictionary(b)), SPANS)
    spans = found.filter(F.col("kind") == REPEAT).select("doc", "twin", "first", "last").unionByName(more)
    spans = materialise(spans.groupBy(F.col("doc").alias("key"), "twin").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(found)
    return spans


def _merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, f in sorted((min(x["first"], n), min(x["last"], n)) for x in spans or ()):
        if s == f:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(f, out[-1][1]))
        else:
            out.append((s, f))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    at, parts = 0, []
    for s, f in spans:
        parts.append(text[at:s])
        at = f
    return b"".join([*parts, text[at:]])


def _digests(data: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for x, found in zip(data.to_pylist(), spans.to_pylist(), strict=True):
        x = _unpacked([x])[0] or b""
        cuts = _merged(found, len(x))
        rows.append({"n_bytes": len(x), "n_removed": sum(f - s for s, f in cuts), "n_spans": len(cuts), "kept_sha256": hashlib.sha256(kept_bytes(x, cuts)).hexdigest()})
    return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _kept_text(data: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left, without the characters of which a part was removed."""
    out = []
    for x, found in zip(data.to_pylist(), spans.to_pylist(), strict=True):
        x = _unpacked([x])[0]
        out.append(None if x is None else kept_bytes(x, _merged(found, len(x))).decode("utf-8", "ignore"))
    return pa.array(out, pa.string())


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with spans; the text travels compressed."""
    spans = repeated_spans(docs, id_col, text_col).withColumnsRenamed({"key": "__key", "twin": "__twin", "spans": "__spans"})
    key, twin = _key(id_col, text_col)
    keyed = docs.withColumn("__key", key).withColumn("__twin", twin).withColumn("__data", F.arrow_udf(_packed, "binary")(F.col(text_col))).drop(text_col)
    return keyed.join(spans, ["__key", "__twin"], "left")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    digest: Column = F.arrow_udf(_digests, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")(F.col("__data"), F.col("__spans"))
    slim = docs.select(id_col, text_col)
    return _with_spans(slim, id_col, text_col).select(id_col, digest.alias("__d")).select(id_col, "__d.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their repeated spans removed from the text; n_chars follows where there is such a column."""
    names = docs.columns
    # named nondeterministic, or a filter on the text would be pushed below it and every text cut twice
    cut = F.arrow_udf(_kept_text, "string").asNondeterministic()
    out = _with_spans(docs, id_col, text_col).withColumn(text_col, cut(F.col("__data"), F.col("__spans")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)
