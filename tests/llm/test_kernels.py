"""Kernels against brute force, without Spark."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import neardup, packing, suffix

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_shingle_sets():
    dice = random.Random(3)
    texts = ["", "a", " a b", "A b c d e", None, "\n\n", "x y z w  v\tu", "x y z w v u", "é É à b c", "a b c d e"]
    texts += [" ".join(dice.choice("abc") for _ in range(dice.randint(0, 40))) for _ in range(300)]
    want = [frozenset(shingles(t, 4)) for t in texts]
    got = dict(neardup.shingle_sets(pa.array(texts), 4))
    assert [len(got[i]) for i in range(len(texts))] == [len(x) for x in want]
    ids = {}
    for i, x in enumerate(want):
        assert ids.setdefault(x, neardup.class_id(got[i])) == neardup.class_id(got[i])
    assert len(set(ids.values())) == len(ids)
    for i in range(300):
        j = dice.randrange(len(texts))
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_posterior_bounds_rise():
    steps = neardup.least_matches(0.8, 1e-5)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160]
    assert all(m <= 0.8 * n for n, m in steps) and steps[-1][1] > 100


def removed(docs, length=100):
    seen, out = set(), []
    for d in docs:
        b = (d or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (s := b[i : i + length]) in seen:
                m[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        out.append(bytes(m))
    return out


def stream(batches, size, schema, *order):
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: tuple(r[c] for c in order))
    return [pa.RecordBatch.from_pylist(rows[i : i + size], schema=schema) for i in range(0, len(rows), size)]


def found(docs, size):
    """The parse, the dictionary and the spans, as the Spark jobs do them."""
    text, ids, half = pa.array(docs, pa.string()), pa.array(range(len(docs)), pa.int64()), len(docs) // 2
    twins = pa.array([zlib.crc32((d or "").encode()) for d in docs], pa.int64())
    parts = [pa.RecordBatch.from_arrays([ids[s], twins[s], text[s]], names=["id", "twin", "text"]) for s in (slice(0, half), slice(half, None))]
    runs, spans = {}, {}
    for b in suffix.settle(stream(suffix.parse(iter(parts)), size, suffix._PARSE, "k1", "k2", "doc", "twin", "at")):
        for x in b.to_pylist():
            if x["kind"] == suffix.REPEAT:
                spans.setdefault(x["doc"], []).append({"first": x["first"], "last": x["last"]})
            else:
                runs.setdefault(x["doc"], []).append({c: x[c] for c in ("t", "first", "last", "kind")})
    kind = pa.list_(pa.struct([("t", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("kind", pa.int32())]))
    k = sorted(runs)
    b = pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), twins.take(pa.array(k, pa.int64())), suffix._packed(pa.array([docs[i] for i in k], pa.string())), pa.array([runs[i] for i in k], kind)], names=["key", "twin", "data", "runs"])
    rows = [r for x in suffix.entries(iter([b])) for r in x.to_pylist()]
    for r in rows:
        r["t"] = hash(r["data"]) if r["spread"] else r["t"]
    rows = pa.RecordBatch.from_pylist(rows, schema=suffix._PHRASES)
    for b in suffix.dictionary(iter(stream([rows], size, suffix._PHRASES, "t", "spread", "doc", "twin", "at"))):
        for x in b.to_pylist():
            spans.setdefault(x["doc"], []).append({"first": x["first"], "last": x["last"]})
    out = []
    for i, d in enumerate(docs):
        m = bytearray(len((d or "").encode()))
        for s, e in suffix._merged(spans.get(i), len(m)):
            m[s:e] = b"\1" * (e - s)
        out.append(bytes(m))
    return out


def test_suffix_array():
    dice = random.Random(8)
    texts = [bytes(dice.choice(b"ab\0") for _ in range(dice.choice([0, 50, 99, 100, 101, 180]))) for _ in range(40)]
    texts += texts[:5] + [b"a" * 150, b"a" * 120]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    row, place, same = suffix.suffix_array(np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = sorted((t[p : p + 100], i, p) for i, t in enumerate(texts) for p in range(len(t) - 99))
    assert [(texts[i][p : p + 100], i, p) for i, p in zip(row, place, strict=True)] == want
    assert list(same) == [k > 0 and want[k][0] == want[k - 1][0] for k in range(len(want))]


@pytest.mark.parametrize("trial", range(6))
def test_repeated_spans(trial, monkeypatch):
    dice = random.Random(trial)
    words = ["".join(dice.choice("abcdefgé") for _ in range(dice.randint(1, 6))) for _ in range(400)]
    if trial % 2:  # long texts in parts
        whole = suffix.pieces
        monkeypatch.setattr(suffix, "pieces", lambda c, limit, overlap: whole(c, limit=300, overlap=overlap))
    base = [" ".join(dice.choice(words) for _ in range(60)) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(dice.randint(0, 6)):
            kind = dice.random()
            if kind < 0.5:
                s = dice.choice(base)
                i = dice.randint(0, len(s) - 1)
                parts.append(s[i : i + dice.randint(1, 300)])
            elif kind < 0.6:
                parts.append("a" * dice.randint(1, 400))
            elif kind < 0.7:
                parts.append("ab " * dice.randint(1, 200))
            else:
                parts.append(" ".join(dice.choice(words) for _ in range(dice.randint(1, 50))))
        docs.append("".join(parts) if dice.random() < 0.95 else None)
    assert found(docs, 1 + 6 * trial) == removed(docs)
    monkeypatch.setattr(suffix, "CHUNK", 3)
    assert found(docs, 1 + 6 * trial) == removed(docs)
    monkeypatch.setattr(suffix, "GROUP", 1)  # triggers of many phrases
    assert found(docs, 1 + 6 * trial) == removed(docs)


def test_bucket_lengths_are_optimal():
    dice = random.Random(5)
    for _ in range(200):
        n = dice.randint(1, 9)
        lengths, counts = np.array(sorted(dice.sample(range(50), n))), np.array([dice.randint(1, 5) for _ in range(n)])
        k = dice.randint(1, 5)
        pad = lambda ends: sum(c * (min(x for x in ends if x >= v) - v) for v, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(pad([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, n) - 1))
        assert pad(packing.bucket_lengths(lengths, counts, k)) == best


def test_long_texts_are_hashed_in_parts(monkeypatch):
    dice = random.Random(6)
    texts = ["".join(dice.choice("ab \n") for _ in range(dice.randint(0, 300))) for _ in range(50)] + ["x" * 200, " " * 100, "x" * 100 + " y z", ""]
    want = dict(neardup.shingle_sets(pa.array(texts), 4))
    whole = neardup.pieces
    monkeypatch.setattr(neardup, "LONG", 16)
    monkeypatch.setattr(neardup, "pieces", lambda c: whole(c, limit=16))
    got = dict(neardup.shingle_sets(pa.array(texts), 4))
    assert all((got[i] == want[i]).all() and len(got[i]) == len(want[i]) for i in range(len(texts)))
