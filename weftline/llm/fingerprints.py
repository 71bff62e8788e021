"""Merkle trees over the sections, paragraphs and sentences of a document.

A paragraph is a line with its line break. A section ends after a blank line, or after a paragraph whose digest's
first byte is a multiple of 8, so sections are found again after an edit elsewhere. A paragraph's leaves are its
sentences, cut after a stop and white space; a sentence is cut further after LEAF characters. Every node's digest is
BLAKE2b of its children's digests, so equal roots mean equal texts.

Edits are located by a descent from both roots: at each level the children of what differs are aligned in order (equal
beginnings, equal ends, and between them digests that both sides have once, as far as their order agrees), and only
what is left between aligned children is gone into. So deletions, insertions, repetitions and moves (which are a deletion
and an insertion) are all found where they are.

The fingerprint is a string: the root's digest, then for each section its short digest and '=', for each paragraph its
short digest and '+', and the leaves' short digests, with '.' between leaves, ',' after a paragraph and ';' after a
section; so two fingerprints can be compared branch by branch. Likeness of two fingerprints is the Dice coefficient of
their multisets of leaves: 1 for equal texts, about the share that is kept after an edit.

Neighbours (the next document by id) are found without a global sort in one task: rows are dealt by ranges of ids that
hold about equally many bytes, an id that many rows share being parted by a hash, and sorted inside each; the first row of each
range also goes to the range before it, where it is only looked at.

Defined results: a null text is empty; an empty text has one empty leaf; a long text counts as a whole and has to fit in a
worker with its tree; ids ascend with nulls first, rows of one id by a hash of the text; a single document's next
document is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.prefix import bucket_count, ranges
from weftline.session import materialise, ship_by_value, text_batches

ship_by_value(__name__)

LEAF = 64
SHORT = 8  # hex digits of a node in the fingerprint
_stop = re.compile(r"[.!?]\s+")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def leaves_of(paragraph: str) -> list[str]:
    out, at = [], 0
    for end in [*(m.end() for m in _stop.finditer(paragraph)), len(paragraph)]:
        out += [paragraph[i : min(i + LEAF, end)] for i in range(at, end, LEAF)]
        at = end
    return out


class Tree:
    """Digests by level: sections of paragraphs of leaves."""

    __slots__ = ("root", "sections")

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]] = []
        paragraphs: list[tuple[bytes, list[tuple[bytes, int]]]] = []
        for line in text.split("\n") if text else [""]:
            leaves = [(_digest(_utf8(x)), len(x)) for x in leaves_of(line + "\n")]
            digest = _digest(b"P" + b"".join(d for d, _ in leaves))
            paragraphs.append((digest, leaves))
            if not line.strip() or digest[0] % 8 == 0:
                self._close(paragraphs)
                paragraphs = []
        if paragraphs:
            self._close(paragraphs)
        self.root = _digest(b"R" + b"".join(d for d, _ in self.sections))

    def _close(self, paragraphs: list) -> None:
        self.sections.append((_digest(b"S" + b"".join(d for d, _ in paragraphs)), paragraphs))

    def fingerprint(self) -> str:
        short = lambda d: d.hex()[:SHORT]
        paragraph = lambda p: f"{short(p[0])}+" + ".".join(short(d) for d, _ in p[1])
        return f"{self.root.hex()}:" + ";".join(f"{short(d)}=" + ",".join(map(paragraph, ps)) for d, ps in self.sections)

    def nodes(self) -> list:
        """The tree as (digest, code points, children) nodes; leaves have no children."""
        sections = []
        for digest, ps in self.sections:
            inner = [(d, sum(n for _, n in leaves), [(x, n, []) for x, n in leaves]) for d, leaves in ps]
            sections.append((digest, sum(n for _, n, _ in inner), inner))
        return [(self.root, sum(n for _, n, _ in sections), sections)]


def fingerprint(text: str | None) -> str:
    return Tree(text or "").fingerprint()


_leaf = re.compile(r"[+.]([0-9a-f]+)")


def leaf_list(print_: str) -> list[str]:
    return _leaf.findall(print_, print_.index(":"))


def likeness(a: str, b: str, counts: tuple[Counter, Counter] | None = None) -> float:
    """Of two fingerprints, 0 to 1; 1 only for equal ones."""
    if a == b:
        return 1.0
    x, y = counts or (Counter(leaf_list(a)), Counter(leaf_list(b)))
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return min(2 * both / (sum(x.values()) + sum(y.values())), 1 - 1e-9)


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal digests, rising on both sides."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo][0] == b[lo][0]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi][0] == b[-1 - hi][0]:
        hi += 1
    pairs = [(i, i) for i in range(lo)]
    middle_a, middle_b = range(lo, len(a) - hi), range(lo, len(b) - hi)
    times_a, times_b = Counter(a[i][0] for i in middle_a), Counter(b[j][0] for j in middle_b)
    place = {b[j][0]: j for j in middle_b if times_b[b[j][0]] == 1}
    both = [(i, place[a[i][0]]) for i in middle_a if times_a[a[i][0]] == 1 and a[i][0] in place]
    # the longest part of them that rises
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(both):
        k = bisect_left(tops, j)
        back.append(ends[k - 1] if k else -1)
        tops[k : k + 1], ends[k : k + 1] = [j], [n]
    at, chosen = (ends[-1] if ends else -1), []
    while at >= 0:
        chosen.append(both[at])
        at = back[at]
    pairs += reversed(chosen)
    return pairs + [(len(a) - i, len(b) - i) for i in range(hi, 0, -1)]


def _descend(a: list, b: list, at_a: int, at_b: int, out: list) -> None:
    """Appends (start, end, start, end) of what differs between the nodes a and b; at_a and at_b is where they begin."""
    i = j = 0
    for x, y in [*_aligned(a, b), (len(a), len(b))]:
        gap_a, gap_b = a[i:x], b[j:y]
        size_a, size_b = sum(n for _, n, _ in gap_a), sum(n for _, n, _ in gap_b)
        if gap_a or gap_b:
            inner_a, inner_b = ([c for _, _, cs in gap for c in cs] for gap in (gap_a, gap_b))
            if inner_a and inner_b:
                _descend(inner_a, inner_b, at_a, at_b, out)
            elif out and out[-1][1] == at_a and out[-1][3] == at_b:
                out[-1] = (out[-1][0], at_a + size_a, out[-1][2], at_b + size_b)
            else:
                out.append((at_a, at_a + size_a, at_b, at_b + size_b))
        at_a, at_b = at_a + size_a, at_b + size_b
        if x < len(a):
            at_a, at_b = at_a + a[x][1], at_b + b[y][1]
        i, j = x + 1, y + 1


def differing(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Where two trees differ: spans of the first text and what stands for them in the second one, in code points.

    The texts count with a line break at their end, as the trees have it.
    """
    if a.root == b.root:
        return []
    found: list[tuple[int, int, int, int]] = []
    _descend(a.nodes(), b.nodes(), 0, 0, found)
    return found


def locate_edits(old: str | None, new: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end) in old and (start, end) in new of each edit, whole leaves at a time; an empty span is a place."""
    a, b = len(old or ""), len(new or "")
    return [(min(s, a), min(e, a), min(t, b), min(f, b)) for s, e, t, f in differing(Tree(old or ""), Tree(new or ""))]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long, edited_chars long"


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by range, then real rows by id, then the look-ahead row: each is finished when its next is seen."""
    held, rows, weight = None, [], 0

    def finish(a, b):
        (doc_id, text, tree, print_, counts), (_, following, _, next_print, next_counts) = a, b
        new = edited(text, following)
        if new == text:
            new_print, near, first, changed = print_, 1.0, -1, 0
        else:
            new_tree = Tree(new)
            new_print = new_tree.fingerprint()
            near = likeness(print_, new_print, (counts, Counter(leaf_list(new_print))))
            edits = differing(tree, new_tree)
            first, changed = min(edits[0][2], len(new)), sum(min(f, len(new)) - min(t, len(new)) for _, _, t, f in edits)
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(_utf8(new)).hexdigest(), "fingerprint": print_, "edited_fingerprint": new_print, "near_edited": near, "near_next": likeness(print_, next_print, (counts, next_counts)), "first_edit": first, "edited_chars": changed}

    for batch in batches:
        for bucket, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[0] == bucket:
                if held[1]:  # a second look-ahead row of this range
                    continue
            elif ahead:  # a range without rows of its own
                continue
            tree = Tree(text)
            print_ = tree.fingerprint()
            now = (doc_id, text, tree, print_, Counter(leaf_list(print_)))
            if held and held[0] == bucket:
                rows.append(finish(held[2], now))
                weight += len(text)
            held = (bucket, ahead, now)
            if weight > 2_000_000 or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness to the edited text and the next document.

    first_edit is the code point of the edited text where the first branch begins that differs (-1: none does),
    edited_chars how many code points such branches hold.
    """
    text_batches(docs.sparkSession)
    n = bucket_count(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.shiftrightunsigned(F.xxhash64(text), 1)  # not negative; its first 12 bits part an id that many rows share
    sizes = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), (F.octet_length(text) + 64).cast("long").alias("size")), "print-sizes")
    found = ranges(sizes, "doc_id", n, "size")
    bucket = found.bucket(F.col("doc_id"), F.shiftright("mark", 51))
    # each range with its first row, the range before it and its task; tasks take ranges of about equally many bytes
    parts = sizes.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.sum("size").alias("size"))
    order = Window.orderBy("bucket")  # as many rows as ranges
    everything = Window.partitionBy()
    task = F.floor((F.sum("size").over(order) - F.col("size")) * n / F.sum("size").over(everything)).cast("int")
    parts = parts.withColumn("task", F.least(task, F.lit(n - 1)))
    last = F.struct(F.max("bucket").over(everything).alias("bucket"), F.max("task").over(everything).alias("task"))
    parts = parts.withColumn("prior", F.coalesce(F.lag(F.struct("bucket", "task")).over(order), last))
    parts = materialise(parts.drop("size"), "print-ranges")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), mark.alias("mark")).withColumn("bucket", bucket).join(parts, "bucket")
    own = F.struct("bucket", "task", F.lit(0).alias("ahead"))
    other = F.struct(F.col("prior.bucket").alias("bucket"), F.col("prior.task").alias("task"), F.lit(1).alias("ahead"))
    to = F.when(F.struct("doc_id", "mark").eqNullSafe(F.col("first")), F.array(own, other)).otherwise(F.array(own))
    sent = slim.select("doc_id", "text", "mark", F.explode(to).alias("to")).select("to.*", "doc_id", "text", "mark").repartitionById(n, F.col("task"))
    sent = sent.sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "mark", "text").select("bucket", "ahead", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_edit", pa.int64()), ("edited_chars", pa.int64())])
    return sent.mapInArrow(lambda b: _walk(b, schema), SCHEMA)
