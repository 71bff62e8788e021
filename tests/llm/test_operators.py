"""Operators against plain versions, on small tables with edge cases."""

import hashlib
import json
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import chat, fingerprints, langid, licences, mixing, neardup, packing, queries, sharding, suffix, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size string, bucket int, shard int, node string, key string, label int, target string, taken int, runs string, spans string, n int, id int, sig int, `rank` int, whole int, digest string"


def corpus(seed, n=120):
    """Copies, near copies in chains, shared passages, nulls, empties, repeated rows."""
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdefghié") for _ in range(dice.randint(1, 7))) for _ in range(300)]
    passage = " ".join(dice.choice(vocabulary) for _ in range(70))
    texts = [None, "", " \n\t", "one", "One", "one two", "!!! 123", "x" * 900, "ab " * 300]
    for _ in range(n):
        kind = dice.random()
        if kind < 0.35 and len(texts) > 12:
            w = (dice.choice(texts[9:]) or "x").split(" ")
            for _ in range(dice.randint(0, max(1, len(w) // 25))):
                w[dice.randrange(len(w))] = dice.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            t = " ".join(dice.choice(vocabulary) + dice.choice(["", "", "", ".", "\n"]) for _ in range(dice.randint(1, 160)))
            texts.append(t + passage + t[:30] if kind < 0.5 else t)
    rows = [{"doc_id": i * 3, "text": t, "lang": dice.choice(["aa", "bb", None]), "source": dice.choice(["s0", "s0", "s0", "s1", "é", "s2", None]), "n_chars": None if t is None else len(t)} for i, t in enumerate(texts)]
    dice.shuffle(rows)
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    if extra:
        for x in EXTRA[2:].split(", "):
            name, kind = x.rsplit(" ", 1)
            df = df.withColumn(name.strip("`"), F.lit("7").cast(kind))
    return df.repartition(3)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("extra", [False, True])
def test_sharding(spark, extra):
    rows = corpus(1)
    rows += [dict(rows[4]), dict(rows[4], doc_id=None)]
    got = sharding.shard_by_bytes(frame(spark, rows, extra))
    same(tuples(got, "doc_id", "size", "text_crc32", "shard", "slot"), brute.shards(rows))
    sizes = {s: sum(x[1] for x in brute.shards(rows) if x[3] == s) for s in range(8)}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len((r["text"] or "").encode()) + 1 for r in rows)


@pytest.mark.parametrize("extra", [False, True])
def test_mixing(spark, extra):
    rows = corpus(2)
    rows += [dict(rows[4]), dict(rows[4], doc_id=None)]
    docs = frame(spark, rows, extra)
    mixed = mixing.mix(docs)
    got = tuples(mixed, "doc_id", "size", "source_size", "target", "taken")
    want = sorted(brute.mix(rows), key=repr)
    assert [(a[0], a[1], a[2], round(a[3], 6), a[4]) for a in got] == [(a[0], a[1], a[2], round(a[3], 6), a[4]) for a in want]
    by = {}
    for r in mixed.collect():
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(0 <= aim - taken < 1 for taken, aim in by.values())


def test_mixed_rows(spark):
    """Each source's rows hold what its documents take, also where rows share an id, or have none, or are equal."""
    rows = corpus(3)
    rows += [dict(rows[20], source="s1"), dict(rows[21], doc_id=rows[22]["doc_id"]), dict(rows[23], doc_id=None), dict(rows[24], doc_id=None), dict(rows[24], doc_id=None, source="s2")]
    rows += [{"doc_id": 9, "text": "a b c d e f g", "lang": None, "source": "same", "n_chars": 13 + i} for i in range(40)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    out = mixing.mixed_rows(docs, mixed)
    assert out.columns == docs.columns
    taken, got, copies = {}, {}, {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + brute.words(r["text"])
        copies[(r["doc_id"], r["text"])] = copies.get((r["doc_id"], r["text"]), 0) + 1
        assert r["n_chars"] == len(r["text"]) or r["source"] == "same"
    assert got == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    rows = corpus(4)
    rows += [dict(rows[4]), dict(rows[4], doc_id=None)]
    got = packing.pack(frame(spark, rows, extra), n_buckets=5, token_budget=300)
    same(tuples(got, "doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot"), brute.pack(rows, 5, 300))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = corpus(5, 220)
    rows += [dict(rows[7]), dict(rows[9], doc_id=rows[20]["doc_id"])]
    got = neardup.near_duplicates(frame(spark, rows, True), words=words)
    want = brute.near_duplicates(rows, words)
    same(tuples(got, "doc_id", "n_shingles", "component_id"), want)
    kept = tuples(neardup.one_of_each(frame(spark, rows), words=words), "doc_id", "text")
    linked = {(i, t) for (i, _, c), t in zip(want, (r["text"] for r in rows), strict=True) if i == c}
    assert set(kept) == linked and len(kept) == len(linked)


def test_near_duplicates_without_hub_rounds(spark):
    """The pass over all pairs of mixed buckets is exact by itself."""
    rows = corpus(6, 150)
    got = neardup.near_duplicates(frame(spark, rows), words=4, hub_rounds=0)
    same(tuples(got, "doc_id", "n_shingles", "component_id"), brute.near_duplicates(rows, 4))


def test_components_of_a_long_chain(spark):
    n = 60
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (102, 102)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


@pytest.mark.parametrize("extra", [False, True])
def test_suffix(spark, extra):
    rows = corpus(7)
    rows += [dict(rows[4]), dict(rows[30])]
    got = suffix.span_digests(frame(spark, rows, extra))
    want = [(r["doc_id"], *brute.digests(r["text"], m)) for r, m in zip(rows, brute.repeated(rows), strict=True)]
    same(tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)
    left = suffix.without_repeats(frame(spark, rows, extra))
    assert left.columns == frame(spark, rows, extra).columns
    texts = [(r["doc_id"], r["text"] and bytes(x for x, y in zip(r["text"].encode(), m, strict=True) if not y).decode("utf-8", "ignore")) for r, m in zip(rows, brute.repeated(rows), strict=True)]
    same(tuples(left, "doc_id", "text"), texts)


def test_suffix_texts_of_one_id(spark):
    """Rows that share an id, or have none, are documents of their own where their texts differ."""
    dice = random.Random(11)
    a, b, c, d = ("".join(dice.choice(x) for _ in range(400)) for x in ("abcdefgh", "abcdefgh", "01234567", "abcdefgh"))
    for shared in (None, 7):
        rows = [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": 400} for i, t in ((shared, a), (shared, b), (shared, b[:300] + c[:100]), (shared, a), (9, d), (9, d[:200] + c[200:]))]
        got = tuples(suffix.without_repeats(frame(spark, rows)), "doc_id", "text")
        left = [t for i, t in got if i == shared]
        assert left.count(a) == 2  # one document twice
        assert sorted(t for t in left if t != a) in (sorted([b, c[:100]]), sorted([b[300:], b[:300] + c[:100]]))
        assert sorted(t for i, t in got if i == 9) in (sorted([d, c[200:]]), sorted([d[200:], d[:200] + c[200:]]))
        sums = suffix.span_digests(frame(spark, rows)).collect()
        assert sum(r["n_removed"] for r in sums) == 500 and len(sums) == 6


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    assert {r[0] for r in docs.filter(held).select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect() if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    model = langid.fit(docs.filter(~held))
    rows = docs.filter(held).select("lang", langid.identify(model, F.col("text")).alias("x")).collect()
    assert sum(r["lang"] == r["x"]["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["x"]["rejected"] for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r["x"]["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(None,), ("",), ("12 !!",), ("中文",), ("zqxj kvwq qqzz xxjq " * 30,), ("the and of " * 20,)], "text string")
    x = [r["x"] for r in odd.select(langid.identify(model, F.col("text")).alias("x")).collect()]
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in x[:3]] == [("und", 0.0, True)] * 3
    assert x[3]["lang_pred"] in model.languages and x[4]["rejected"] and not x[5]["rejected"] and x[5]["lang_pred"] == "en"
    again = langid.fit(docs.repartition(5).filter(~held))
    assert (again.centroids == model.centroids).all()


def test_language_against_a_plain_version(spark):
    """Every prediction, score and rejection; ties, repeated rows and columns with clashing names."""
    dice = random.Random(12)
    pools = {"aa": "der die das und nicht ein zu haben werden", "bb": "the of and to in that it is was", "cc": "été où ça être avoir à les une"}
    word = lambda x: dice.choice(pools[x].split()) + dice.choice(["", "", "en", "ing", "és"])
    rows = [(i, " ".join(word(x) for _ in range(dice.randint(10, 60))), x) for i, x in enumerate(sorted(pools) * 25)]
    rows += [(rows[0][0], *rows[0][1:]), (None, *rows[1][1:]), (900, None, "aa"), (901, "", "bb"), (902, "ab", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("chance", F.lit("x")).withColumn("n", F.lit(1)).withColumn("at", F.lit(2)).withColumn("lang_pred", F.lit("zz"))
    model = langid.fit(labelled)
    plain = brute.Language({x: [t for _, t, y in rows if y == x and t is not None] for x in pools})
    odd = ["zq xj kv wq" * 20, "12 !!", "", None, "der the été", "the " * 40, "中文字符" * 20, "THE OF AND TO " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t, _ in rows] + odd)], "i long, text string")
    for r in df.select("text", langid.identify(model, F.col("text")).alias("x")).collect():
        lang, score, rejected = plain(r["text"])
        assert r["x"]["lang_pred"] == lang and abs(r["x"]["score"] - score) < 2e-5, r
        if r["text"] and len(r["text"]) > 80 and abs(score - 0.1) > 1e-3:
            assert r["x"]["rejected"] == rejected, (r, score)


def test_language_of_short_texts(spark):
    """Lengths that the sample lacks have limits too, on tables of any size."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = ["zqxj kvwq qqzz xxjq", "wjqzxkvpqhgxzqjw", "źdźbło żółć gęślą", "中文字符", "qz"]
    df = spark.createDataFrame([(x,) for x in odd], "text string")
    few = docs.filter("lang is not null and n_chars > 500").withColumn("n", F.expr("row_number() over (partition by lang order by doc_id)")).filter("n <= 2").drop("n")
    for model in (langid.fit(docs), langid.fit(few)):
        found = [r["x"] for r in df.select(langid.identify(model, F.col("text")).alias("x")).collect()]
        short = docs.filter("lang is not null and n_chars > 500").select("lang", langid.identify(model, F.expr("substr(text, 101, 50)")).alias("x")).collect()
        assert sum(r["x"]["rejected"] for r in short) <= 0.05 * len(short)
        assert all(r["rejected"] for r in found), (found, model.limits)
        assert model.limits.min() > 0


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints(spark, extra):
    """Against a plain version of trees, likeness and first edits."""
    rows = corpus(8)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(frame(spark, rows, extra)).collect()}
    order = sorted(rows, key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for i, r in enumerate(order):
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        (mine, leaves), (edited, new_leaves), (_, after_leaves) = map(brute.tree_print, (text, new, after))
        x = got[r["doc_id"]]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert x["fingerprint"] == mine and x["edited_fingerprint"] == edited
        assert abs(x["near_edited"] - brute.dice_of(leaves, new_leaves)) < 1e-8 and abs(x["near_next"] - brute.dice_of(leaves, after_leaves)) < 1e-8
        assert x["first_edit"] == min(brute.first_difference(leaves, new_leaves), len(new)) and x["edited_chars"] <= len(new)
        assert (x["fingerprint"] == x["edited_fingerprint"]) == (text == new) == (x["near_edited"] == 1) == (x["first_edit"] == -1)
    one = fingerprints.fingerprint_neighbours(frame(spark, order[20:21])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_fingerprints_of_shared_ids(spark):
    """Rows without an id or with one id are put in order by a hash of the text; each has one next document."""
    rows = [{"doc_id": i, "text": f"text {k}. " * (k % 7 + 1), "lang": None, "source": None, "n_chars": 0} for k, i in enumerate([None] * 60 + [5] * 300 + list(range(40)))]
    rows += rows[:3] + rows[100:103]
    got = fingerprints.fingerprint_neighbours(frame(spark, rows)).collect()
    same(tuples(spark.createDataFrame(got).select("doc_id", "fingerprint"), "doc_id", "fingerprint"), [(r["doc_id"], brute.tree_print(r["text"])[0]) for r in rows])
    # every text but the first follows another one: edited texts end with beginnings of as many next texts
    after = [r["near_next"] for r in got]
    assert len(after) == len(rows) and sum(x == 1 for x in after) >= 6


def text_of(dice, n=40):
    word = lambda: dice.choice(["alpha", "beta", "gamma", "delta"]) + str(dice.randrange(99))
    return [". ".join(" ".join(word() for _ in range(6)) for _ in range(3)) for _ in range(n)]


def test_fingerprints_locate_edits():
    lines = text_of(random.Random(2))
    text = "\n".join(lines)
    assert fingerprints.locate_edits(text, text) == []
    at = text.index("\n", 1500) + 5
    new = text[:at] + "EDIT" + text[at:]
    (a, z, start, end), = fingerprints.locate_edits(text, new)
    assert a <= at <= z and start <= at and at + 4 <= end <= at + 200 and fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(new)) > 0.95
    assert len({fingerprints.fingerprint(t) for t in ("", "\n", "a", "a\n", "a\n\n", "\na", "a b", "a  b")}) == 8
    # a deletion is where the paragraph was
    start_of = lambda i, ls=lines: sum(len(x) + 1 for x in ls[:i])
    assert fingerprints.locate_edits(text, "\n".join(lines[:7] + lines[8:])) == [(start_of(7), start_of(8), start_of(7), start_of(7))]
    assert fingerprints.locate_edits("\n".join(lines[:7] + lines[8:]), text) == [(start_of(7), start_of(7), start_of(7), start_of(8))]
    # paragraphs that change places are an insertion and a deletion there
    swapped = lines[:3] + [lines[4], lines[3]] + lines[5:]
    edits = fingerprints.locate_edits(text, "\n".join(swapped))
    assert edits and all(start_of(3) <= a <= z <= start_of(5) and start_of(3) <= s <= f <= start_of(5) for a, z, s, f in edits)
    # a repeated paragraph is one more of it
    again = lines[:9] + [lines[8]] + lines[9:]
    edits = fingerprints.locate_edits(text, "\n".join(again))
    assert len(edits) == 1 and edits[0][3] - edits[0][2] == len(lines[8]) + 1 and start_of(8) <= edits[0][2] <= start_of(9)


@pytest.mark.parametrize("seed", range(5))
def test_fingerprints_edits_put_back(seed):
    """What lies outside the edits is equal; with the edits taken over, the texts are."""
    dice = random.Random(seed)
    lines = text_of(dice, 15)
    for _ in range(30):
        new = list(lines)
        for _ in range(dice.randint(1, 4)):
            i, j = dice.randrange(len(new)), dice.randrange(len(new))
            kind = dice.randrange(4)
            if kind == 0:
                del new[i]
            elif kind == 1:
                new.insert(i, new[j])
            elif kind == 2:
                new[i], new[j] = new[j], new[i]
            else:
                new[i] = new[i].replace("alpha", "omega")
            new = new or [""]
        old_text, new_text = "\n".join(lines) + "\n", "\n".join(new) + "\n"
        out, at = "", 0
        for a, z, s, f in fingerprints.differing(fingerprints.Tree(old_text[:-1]), fingerprints.Tree(new_text[:-1])):
            out += old_text[at:a] + new_text[s:f]
            at = z
        assert out + old_text[at:] == new_text


def test_topk(spark):
    dice = random.Random(9)
    rows = [(i, [dice.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (800, [float("nan")] + [0.0] * 7), (900, [1.0, None] + [0.0] * 6), (1000, [float("inf")] * 8), (1100, list(rows[3][1])), (1101, list(rows[3][1])), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, block_rows=150, query_rows=3)
    import numpy as np

    ok = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    same(tuples(got, "query_id", "rank", "vec_id", "score"), want)
    few = topk.top_k(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert topk.top_k(df, F.lit(False)).count() == 0
    assert len(few) == 3 and {r["rank"] for r in few} == {1, 2, 3}


def test_topk_eliminates(spark):
    """Fewer than half of the candidates are evaluated, over the whole table."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    n = vectors.count()
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0)
    seen = [r[0] for r in got.filter("rank = 1").select("evaluated").collect()]
    assert sum(seen) < 0.4 * n * len(seen)


def test_topk_of_large_components(spark):
    """Scores beyond a long are the nearest long; components that aren't finite after scaling take no part."""
    rows = [(0, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [1e300, 0.0]), (4, [1e308, 1.0]), (5, [0.5, 0.5]), (6, [0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 5), k=10).collect()
    top, low = 2**63 - 1, -(2**63)
    want = {0: [(1, top), (3, top), (5, 1024 * 10**12 * 512 + 512 * 1024), (6, 0), (2, low)], 5: [(3, top), (0, 1024 * 10**12 * 512 + 512 * 1024), (1, 1024 * 10**12 * 512), (6, 0), (2, -1024 * 10**12 * 512)]}
    assert {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    zeros = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(zeros, F.col("vec_id") == 2).orderBy("rank").collect()] == [0, 1, 3]


def sent_to_driver(spark, run):
    """Bytes of all tasks' results in the stages of a call."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for i, n in stages().items() if i not in before)


def test_topk_sends_no_copies_to_the_driver(spark):
    """What the driver gets doesn't grow with the vector blocks that queries meet, nor with the table's partitions."""
    dice = random.Random(4)
    rows = [(i, [dice.gauss(0, 1) for _ in range(32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    call = lambda **x: sent_to_driver(spark, lambda: topk.top_k(df, F.col("vec_id") % 10 == 0, n_seeds=100, **x))
    (one, few_bytes), (many, bytes_sent) = call(), call(block_rows=100, query_rows=30)
    assert bytes_sent < few_bytes + 500_000  # 300 queries of 464 bytes and 30 blocks: 4 MB as copies
    assert few_bytes < 300_000  # 8 tasks of 100 seeds each: 260 kB, besides reports
    key = ("query_id", "rank", "vec_id", "score")
    same(tuples(many, *key), tuples(one, *key))


def test_topk_seeds_are_the_lowest_hashes(spark):
    """Whether ids differ or all are the same, as many seeds as there can be, in the order of hashes."""
    df = spark.range(2000).select("id", F.array(F.col("id").cast("float")).alias("v"))
    want = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(20).collect()]
    assert [r["id"] for r in topk.seed_rows(df, 2000, 20)] == want
    assert len(topk.seed_rows(df.withColumn("id", F.lit(5)), 2000, 20)) == 20
    assert len(topk.seed_rows(df.filter("id < 7"), 7, 20)) == 7


def test_topk_of_scores_below_a_long(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [-1e12, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=10)
    assert tuples(got.orderBy("rank"), "vec_id", "score") == [(1, 2**63 - 1), (2, -(2**63))]


class Rewriting(chat.TurnTemplate):
    """Numbers all turns from the end, and so changes what it said before."""

    def render(self, turns, add_generation_prompt=False):
        return "".join(f"{len(turns) - i}: {super(Rewriting, self).render([t])}" for i, t in enumerate(turns))


def test_chat(spark):
    dice = random.Random(10)
    bits = ["</s>", "[INST]", "<|turn|>", "<|end|>", "\\", "\\-", "\n", "<", "|", "hello", "é", "<|im_end|>", "assistant\n", ""]
    rows = []
    for c in range(60):
        for t in range(dice.randint(1, 9)):
            rows.append((c, t, dice.choice(["user", "assistant", "sys\ntem", None]), dice.choice([None, "".join(dice.choice(bits) for _ in range(dice.randint(0, 8)))])))
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1)).repartition(3)
    template = chat.TurnTemplate()
    got = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        turns = [(role, text) for _, _, role, text in turns]
        assert template.parse(r["formatted"]) == turns and r["formatted"] == template.render(turns) and not r["rewrites"]
        assert [template.unescape(r["formatted"][x["start"] : x["end"]]) for x in r["loss"]] == [t for role, t in turns if role == "assistant"]
        assert [r["formatted"][x["start"] : x["end"]] for x in r["spans"]] == [template.render([t]) for t in turns]
        assert not any(x in template.escape(t) for _, t in turns for x in template.CONTROL)
    text, _, _, rewrites = chat.format_turns([("user", "a"), ("assistant", "b"), ("user", "c")], Rewriting())
    assert rewrites == [1, 2] and text.startswith("3: ")


class Forgetting(chat.TurnTemplate):
    """Drops what replies before the last turn thought."""

    def render(self, turns, add_generation_prompt=False):
        cut = lambda i, x: re.sub("<think>.*?</think>", "", x) if i < len(turns) - 1 else x
        return super().render([(role, cut(i, x)) for i, (role, x) in enumerate(turns)], add_generation_prompt)


class Telling(chat.TurnTemplate):
    """Says at the top how long the last turn is and drops system turns but the first."""

    def render(self, turns, add_generation_prompt=False):
        kept = [t for i, t in enumerate(turns) if t[0] != "system" or not i]
        return f"{len(turns[-1][1])}\n" + super().render(kept, add_generation_prompt)


def test_chat_masks_of_rewritten_history(spark):
    """What is learned is text of replies in the final rendering, never control text or another turn."""
    turns = [("user", "question"), ("assistant", "<think>long thoughts</think>one"), ("user", "more"), ("assistant", "<think>x</think>two"), ("user", "<end"), ("assistant", "")]
    for n in range(1, len(turns) + 1):
        text, spans, loss, rewrites = chat.format_turns(turns[:n], Forgetting())
        said = [re.sub("<think>.*?</think>", "", x) if i < n - 1 else x for i, (_, x) in enumerate(turns[:n])]
        assert text == chat.TurnTemplate().render([(r, x) for (r, _), x in zip(turns, said, strict=False)])
        learned = [text[a:z] for a, z in (x for x in loss if x)]
        assert learned == [x for (r, _), x in zip(turns, said, strict=False) if r == "assistant"], (n, rewrites)
        if rewrites:
            assert [text[a:z] for a, z in spans] == said
    text, spans, loss, rewrites = chat.format_turns([("system", "a"), ("user", "b"), ("system", "dropped"), ("assistant", "reply"), ("assistant", "12")], Telling())
    assert rewrites and spans[2] is None and [text[a:z] for a, z in (x for x in loss if x)] == ["reply"]  # the last one changes the top too
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df, Forgetting()).first()
    assert [row["formatted"][x["start"] : x["end"]] for x in row["loss"]] == ["one", "two", ""] and row["rewrites"]


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    texts = [(1, mit), (2, "Copyright (c) 2020 A. N. Other\n\n" + mit.upper()), (3, "* (c) Someone\n" + mit.replace("sublicense", "sub-licence").replace("\n", "\n * ")), (4, mit + " More."), (5, None), (6, ""), (7, "Some prose.\nreleased under the mit licence\nMore."), (7, mit)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit(0)).withColumn("notices", F.lit(0))
    got = tuples(licences.scan(df), "doc_id", "licence_id", "notices")
    assert got == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, "MIT", ""), (4, None, ""), (5, None, ""), (6, None, ""), (7, None, "MIT-notice"), (7, "MIT", "")], key=repr)


def test_licence_files(spark):
    """Files as they are shipped: titles, claims, other line breaks."""
    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))

    known = licences.KNOWN
    claim = "Copyright (c) 2020, A. N. Other\n"
    files = [("MIT", "MIT License\n\n" + claim + "\n" + wrapped(known["MIT"], w)) for w in range(60, 81)]
    files += [("BSD-2-Clause", "BSD 2-Clause License\n\n" + claim + "All rights reserved.\n\n" + wrapped(known["BSD-2-Clause"], w)) for w in range(60, 81)]
    files += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + claim + wrapped(known["BSD-3-Clause"], 75))]
    files += [("ISC", "ISC License\n\nCopyright 2020 Someone\n\n" + wrapped(known["ISC"], 70)), ("MIT", "The MIT License (MIT)\n\n" + "Copyright (c) 2020 X. All rights reserved. " + known["MIT"].replace("\n", " "))]
    files += [(x, known[x]) for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")]
    files += [("Apache-2.0", known["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Someone"))]
    got = {r["doc_id"]: r["licence_id"] for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(files))] == [x for x, _ in files]


def test_files_of_the_licence_query(spark):
    """Every file hits but those with more text."""
    files = queries.licence_files()
    got = {r["doc_id"]: r["licence_id"] for r in licences.scan(spark.createDataFrame(files, "doc_id long, text string")).collect()}
    for i, name in enumerate(sorted(licences.KNOWN)):
        assert [got[-10 * i - k - 1] for k in range(5)] == [name] * 4 + [None]


def test_licences_known_as_a_table(spark):
    known = spark.createDataFrame([("b", "Do as you like per cent."), ("a", "do AS you  like, percent")], "licence_id string, text string")
    docs = spark.createDataFrame([(1, "Do as you like, per cent!"), (2, "do as you like per center"), (3, "x\nlicence licence\ny"), (4, "Copyright (c) 2020 X\ndo as you like percent")], "doc_id long, text string")
    assert tuples(licences.scan(docs, known), "doc_id", "licence_id") == [(1, "a"), (2, None), (3, None), (4, "a")]
    forms = {r["f"] for r in docs.select(licences.canonical(F.col("text")).alias("f")).collect()}
    assert "x license license y" in forms and "do as you like per center" in forms


def test_long_texts(spark):
    """Texts beyond a piece of 512 kB count as a whole."""
    dice = random.Random(13)
    long = " ".join(dice.choice("abcdefgh") * dice.randint(1, 9) for _ in range(150_000))
    rows = [{"doc_id": i, "text": t, "lang": "aa", "source": "s", "n_chars": len(t)} for i, t in enumerate([long, long + " end", long[600_000:], "short text here", "\n".join([long[:300_000], long[-300_000:]])])]
    docs = frame(spark, rows).coalesce(1)
    same(tuples(sharding.shard_by_bytes(docs), "doc_id", "size", "text_crc32", "shard", "slot"), brute.shards(rows))
    same(tuples(packing.pack(docs), "doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot"), brute.pack(rows))
    assert [x[4] for x in tuples(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken")] == [x[4] for x in sorted(brute.mix(rows), key=repr)]
    same(tuples(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id"), brute.near_duplicates(rows, 5))
    got = {r["doc_id"]: r for r in suffix.span_digests(docs).collect()}
    assert got[1]["n_removed"] == len(long) and got[2]["n_removed"] == len(long) - 600_000 and got[4]["n_removed"] == 600_000 and got[0]["n_removed"] == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_neighbours(docs).collect()}
    assert all(prints[r["doc_id"]] == brute.tree_print(r["text"])[0] for r in rows[2:])
    scanned = {r["doc_id"]: r["canonical_chars"] for r in licences.scan(docs).collect()}
    assert scanned[0] == len(long.strip())
    model = langid.fit(docs)
    assert docs.select(langid.identify(model, F.col("text")).alias("x")).filter("x.lang_pred = 'aa'").count() == 5
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).first()
    assert row["formatted"][row["loss"][0]["start"] : row["loss"][0]["end"]] == long


def test_near_duplicates_of_null_and_shared_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    rows = corpus(14, 60)
    for i, r in enumerate(rows):
        r["doc_id"] = None if i % 3 == 0 else 7 if i % 3 == 1 else r["doc_id"] + 100
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    order = sorted(range(len(rows)), key=lambda i: repr(rows[i]["text"]))
    numbered = [dict(rows[i], doc_id=i) for i in order]
    groups = {}
    for i, _, c in brute.near_duplicates(numbered, 5):
        groups.setdefault(c, []).append(i)
    want = []
    for members in groups.values():
        ids = [rows[i]["doc_id"] for i in members if rows[i]["doc_id"] is not None]
        alone = len(members) == 1
        want += [(rows[i]["doc_id"], len(brute.shingles(rows[i]["text"], 5)), rows[i]["doc_id"] if alone else min(ids, default=None)) for i in members]
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], want)


def test_empty_tables(spark):
    docs = frame(spark, [])
    for f in (sharding.shard_by_bytes, mixing.mix, packing.pack, neardup.near_duplicates, neardup.one_of_each, suffix.span_digests, suffix.without_repeats, fingerprints.fingerprint_neighbours, licences.scan):
        assert f(docs).count() == 0, f
    assert langid.fit(docs) is None and docs.select(langid.identify(None, F.col("text"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_nulls_everywhere(spark):
    rows = [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}] * 3
    docs = frame(spark, rows)
    for f in (sharding.shard_by_bytes, mixing.mix, packing.pack, neardup.near_duplicates, suffix.span_digests, fingerprints.fingerprint_neighbours, licences.scan):
        assert f(docs).count() == 3, f
    assert langid.fit(docs) is None
    assert json.loads(json.dumps([r.asDict() for r in neardup.near_duplicates(docs).select("doc_id", "component_id").collect()])) == [{"doc_id": None, "component_id": None}] * 3
