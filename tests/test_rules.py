"""Rewriting, packed machines, files, symbols and streams."""

import os
import random
import re
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weftline.convert import convert
from weftline.functions.machine import Machine, acceptor, any_of, chain, transducer, trie
from weftline.functions.sql import register_machine, register_paths, register_rule, register_semiring_sum
from weftline.iso import isomorphic
from weftline.model import batch, frame
from weftline.operators import rewrite
from weftline.operators.rewrite import Rule, UnsupportedRewrite, cdrewrite
from weftline.plans.kernel import Kernel
from weftline.plans.packed import InvalidFormat, Packed
from weftline.sources import att, binary, symbols
from weftline.streaming.apply import follow, rewrite_stream

AZ = b"abcdefghijklmnopqrstuvwxyz"

CASES = [
    (Rule({"a": "b"}, sigma=AZ), {"a": "b", "hello": "hello", "": "", "A": None}),
    (Rule({"ab": "xy"}, sigma=AZ), {"ab": "xy", "ac": "ac", "cab": "cxy", "aab": "axy"}),
    (Rule({"a": "b"}, ["c"], ["d"], AZ), {"cad": "cbd", "cab": "cab", "xad": "xad"}),
    (Rule({"ab": "xy"}, ["c"], ["d"], AZ), {"cabd": "cxyd", "cacd": "cacd"}),
    (Rule({"a": "b"}, ["c", "x"], ["d"], AZ), {"cad": "cbd", "xad": "xbd", "yad": "yad"}),
    (Rule({"ab": "x", "bcd": "y"}, sigma=AZ), {"abcd": "ay", "abab": "xx"}),
    (Rule({"ab": "xyz", "q": ""}, sigma=AZ), {"abqab": "xyzxyz", "q": ""}),
    (Rule({"é": "e", "中": "Z"}), {"é中x": "eZx"}),
    (Rule({"a": "b"}, ["b"], ["b"]), {"babab": "bbbab"}),  # contexts are consumed
]


@pytest.mark.parametrize("rule,cases", CASES, ids=range(len(CASES)))
def test_cdrewrite(spark, rule, cases):
    df = spark.createDataFrame([(w,) for w in [*cases, None]], "w string")
    for way in (rule.apply(F.col("w")), rule.kernel(F.col("w"))):
        got = {r["w"]: r["x"] for r in df.select("w", way.alias("x")).collect()}
        assert got.pop(None) is None
        if "babab" in cases:
            assert got["babab"] in ("bbbab", "babbb")
        else:
            assert got == cases


def test_lowering():
    import string

    low = lambda r: {p for p in r.patterns()}
    assert low(Rule({"a": "b"}, ["c"], ["d", "e"])) == {"cad", "cae"} and string.ascii_lowercase.encode() == AZ


def test_lowering_is_refused_where_matches_meet(spark):
    c = F.col("w")
    assert Rule({"ab": "x", "bc": "y"}).lowered(c) is None and Rule({"aa": "b"}).lowered(c) is None
    assert Rule({"ab": "x", "b": "y"}).lowered(c) is None and Rule({"a": "cd", "cd": "e"}).lowered(c) is None
    assert Rule({"ab": "x"}).lowered(c) is not None


def test_rules_that_are_refused():
    with pytest.raises(UnsupportedRewrite):
        cdrewrite(chain([98], [99], 2.0))
    with pytest.raises(UnsupportedRewrite):
        cdrewrite(transducer("", "x"))
    assert cdrewrite(Machine()).num_states == 0


def test_kernel_weights(spark):
    m = any_of([chain([98], [100], 2.0), chain([98], [101], 1.0)])
    assert Kernel(m).run([b"a", b"b", b""]) == [(b"d", 1.0), (None, float("inf")), (None, float("inf"))]
    got = spark.createDataFrame([("a",), ("b",), (None,)], "w string").select(rewrite.best_output(F.col("w"), m).alias("x")).collect()
    assert [(r["x"]["output"], r["x"]["weight"]) for r in got] == [("d", 1.0), (None, None), (None, None)]


def test_packed():
    m = trie(["ab", "ac", "b"])
    p = Packed.of(m)
    data = p.to_bytes()
    assert len(data) == 24 + 16 * m.num_states + 24 * m.num_arcs
    assert isomorphic(Packed.from_bytes(data).machine(), m)
    assert p.find_arc(0, 98)["dst"] == 1 and p.find_arc(0, 120) is None and len(p.arcs_by_ilabel(1, 99)) == 1
    for bad in (data[:10], data[:-1], b"\0" + data[1:], data[:16] + b"\x63\0\0\0" + data[20:], data[:-8] + b"\x63\0\0\0" + data[-4:], data[:24] + b"\xff\xff\0\0" + data[28:]):
        with pytest.raises(InvalidFormat):
            Packed.from_bytes(bad)
    swapped = Packed(p.start, p.states, p.arcs[::-1].copy()).to_bytes()
    with pytest.raises(InvalidFormat):
        Packed.from_bytes(swapped)


def test_binary_files(spark, tmp_path):
    two = batch([trie(["ab", "c"]).frame(spark, 0), frame(spark, 1, None, {}, [], 0)])
    rows = binary.encode(two).collect()
    for r in rows:
        (tmp_path / f"{r['fst_id']}.bin").write_bytes(bytes(r["data"]))
    back, names = binary.read_binary(spark, str(tmp_path), "*.bin")
    assert names.count() == 2 and {r["fst_id"]: r["start"] for r in back.meta.collect()} == {0: 0, 1: None}
    assert isomorphic(Machine.of(back.with_(meta=back.meta.filter("fst_id = 0"), states=back.states.filter("fst_id = 0"), arcs=back.arcs.filter("fst_id = 0"))), trie(["ab", "c"]))
    binary.write_parquet(two, str(tmp_path / "pq"))
    assert binary.read_parquet(spark, str(tmp_path / "pq")).arcs.count() == 3


ATT = "0\t1\t97\t98\t0.5\n\n1 2 5\r\n1\t2\t7\t2.5\n2\t0.5\n1\n3 inf\n"


def test_att(spark, tmp_path):
    (tmp_path / "a_tagger.fst.txt").write_text(ATT)
    (tmp_path / "b_tagger.fst.txt").write_text("4 0 0 0\n0\n")
    (tmp_path / "c.txt").write_text("0 1 1\n1\n")
    f, names = att.read_att(spark, str(tmp_path), "*_tagger.fst.txt")
    assert names.count() == 2 and {r["fst_id"]: r["start"] for r in f.meta.collect()} == {0: 0, 1: 4}
    assert {tuple(r)[1:] for r in f.arcs.filter("fst_id = 0").collect()} == {(0, 97, 98, 0.5, 1), (1, 5, 5, 0.0, 2), (1, 7, 7, 2.5, 2)}
    assert {r["state"]: r["final_weight"] for r in f.states.filter("fst_id = 0").collect()} == {0: None, 1: 0.0, 2: 0.5, 3: None}
    moved, _ = att.read_att(spark, str(tmp_path), "b_*", label_shift=1)
    assert moved.arcs.first()["ilabel"] == 0 and moved.encoding == "byte_plus_one"
    lines = [r["value"] for r in att.att_lines(f).filter("fst_id = 0").orderBy("line_no").collect()]
    assert lines == ["0\t1\t97\t98\t0.5", "1\t2\t5\t5", "1\t2\t7\t7\t2.5", "1", "2\t0.5"]
    att.write_att(f, str(tmp_path / "out"))
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("fst_id")) == ["fst_id=0", "fst_id=1"]


def test_convert(spark, tmp_path):
    (tmp_path / "x_tagger.txt").write_text("0 1 97 98\n1\n")
    out = str(tmp_path / "out")
    assert len(convert(spark, str(tmp_path), out, "*_tagger.txt", dry_run=True)) == 1 and not os.path.exists(out)
    convert(spark, str(tmp_path), out, "*_tagger.txt")
    assert {(r["ilabel"], r["olabel"]) for r in binary.read_parquet(spark, out).arcs.collect()} == {(98, 99)}
    (tmp_path / "y_verbalizer.txt").write_text("0 1 97\n1\n")
    convert(spark, str(tmp_path), out + "b", ["*_tagger.txt", "*_verbalizer.txt"], to="binary", suffix=".bin")
    assert sorted(os.listdir(out + "b")) == ["x_tagger.bin", "y_verbalizer.bin"]
    assert binary.read_binary(spark, out + "b", "*.bin")[0].arcs.count() == 2


def test_sql_functions(spark):
    register_rule(spark, "shout", Rule({"a": "A"}, ["b"], [""]))
    register_machine(spark, "best", any_of([chain([98], [100], 2.0)]))
    row = spark.sql("select shout('baab') x, best('a').output y, best('a').weight z, best('q').output w").first()
    assert (row["x"], row["y"], row["z"], row["w"]) == ("bAab", "c", 2.0, None)


@pytest.mark.parametrize("line", ["not-a-state", "0 1 bad-label", "0 1 1 bad-weight", "0 1 1 1 1 1", "0 1 1 x 0.5", "-1 2 3"])
def test_att_errors(spark, line):
    lines = spark.createDataFrame([(0, 0, "0 1 1"), (0, 1, line)], "fst_id long, line_no int, value string")
    with pytest.raises(att.InvalidFormat):
        att.parse_lines(lines)


def test_symbols(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "t long, s string")
    t = symbols.symbol_table(df, "s", "t")
    assert {r["symbol"]: r["label"] for r in t.collect()} == {"<eps>": 0, "b": 1, "a": 2}
    more = symbols.add_symbol(symbols.add_symbol(t, "c"), "z", 10)
    assert {r["symbol"]: r["label"] for r in more.collect()} == {"<eps>": 0, "b": 1, "a": 2, "c": 3, "z": 10}
    assert symbols.add_symbol(t, "a").count() == 3
    for symbol, label in (("a", 5), ("q", 2)):
        with pytest.raises(symbols.SymbolConflict):
            symbols.add_symbol(t, symbol, label)
    assert {r["t"]: r["label"] for r in symbols.with_labels(df, t, "s").collect()} == {1: 1, 2: 2, 3: 1, 4: None}
    assert symbols.with_symbols(spark.createDataFrame([(2,)], "label long"), t, "label").first()["symbol"] == "a"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "aab", 1), (1, 2, "x", 2), (2, 1, "b", 2)], "user long, t long, text string, label long").write.parquet(src)
    stream = spark.readStream.schema("user long, t long, text string, label long").parquet(src)
    q = rewrite_stream(stream, Rule({"ab": "Z"}), "text").writeStream.format("memory").queryName("rewritten").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["text"] for r in spark.table("rewritten").collect()} == {"aZ", "x", "b"}
    m = Machine()
    m.add_states(3)
    m.set_start(0)
    m.set_final(2)
    m.add_arc(0, 1, 1, 0.0, 1)
    m.add_arc(1, 2, 2, 0.0, 2)
    q = follow(stream, m, "user", "label", "t").writeStream.format("memory").queryName("followed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["user"], r["seen"], r["state"], r["accepted"]) for r in spark.table("followed").collect()} == {(1, 2, 2, True), (2, 1, None, False)}


def test_isomorphism():
    a, b = trie(["ab", "c"]), any_of([acceptor("ab"), acceptor("c")])
    assert isomorphic(a, trie(["c", "ab"])) and not isomorphic(a, b) and not isomorphic(a, trie(["ab", "d"]))


def test_lowered_rules_equal_their_machines(spark):
    """Random small rules on random texts: native replacement and machine agree."""
    dice = random.Random(3)
    words = spark.createDataFrame([("".join(dice.choice("abc") for _ in range(dice.randint(0, 9))),) for _ in range(150)], "w string").coalesce(1).cache()
    rules = [Rule({"b": "", "ac": "z"}), Rule({"b": "", "c": ""}), Rule({"a": "", "b": "x"}), Rule({"yz": "1", "z": "2"}, ["x", "xy"])]
    while len(rules) < 40:
        tau = {"".join(dice.choice("abc") for _ in range(dice.randint(1, 2))): "".join(dice.choice("abcxy") for _ in range(dice.randint(0, 2))) for _ in range(dice.randint(1, 3))}
        rules.append(Rule(tau, dice.choice([[""], ["a"], ["", "c"]]), dice.choice([[""], ["b"]]), sigma=dice.choice([None, b"abc", b"ab"])))
    lowered = [r for r in rules if r.lowered(F.col("w")) is not None]
    assert len(lowered) >= 8 and rules[0] in lowered and rules[3] not in lowered
    pick = [x for i, r in enumerate(lowered) for x in (r.lowered(F.col("w")).alias(f"a{i}"), r.kernel(F.col("w")).alias(f"b{i}"))]
    for row in words.select("w", *pick).collect():
        for i, r in enumerate(lowered):
            assert row[f"a{i}"] == row[f"b{i}"], (r, row["w"])


def test_outputs_that_are_no_text(spark):
    m = any_of([chain([98], [256])])
    row = spark.createDataFrame([("a",)], "w string").select(rewrite.best_output(F.col("w"), m).alias("x")).first()
    assert row["x"]["output"] is None and row["x"]["weight"] == 0


def vector_file(finals, arcs, start, kind=b"vector", arc=b"standard", symbols=()):
    text = lambda x: struct.pack("<i", len(x)) + x
    out = struct.pack("<i", 2125659606) + text(kind) + text(arc) + struct.pack("<iiQqqq", 2, 1 if symbols else 0, 0, start, len(finals), sum(map(len, arcs)))
    if symbols:
        out += struct.pack("<i", 2125658996) + text(b"names") + struct.pack("<qq", 9, len(symbols)) + b"".join(text(s) + struct.pack("<q", i) for i, s in enumerate(symbols))
    for w, a in zip(finals, arcs, strict=True):
        out += struct.pack("<fq", w, len(a)) + b"".join(struct.pack("<iifi", *x) for x in a)
    return out


def test_vector_files(spark, tmp_path):
    inf = float("inf")
    data = vector_file([inf, 0.5], [[(97, 98, 1.5, 1), (0, 99, 0.0, 0)], []], 0, symbols=[b"<eps>", b"a"])
    (tmp_path / "a.fst").write_bytes(data)
    f, names = binary.read_vector(spark, str(tmp_path), "*.fst")
    assert {tuple(r)[1:] for r in f.arcs.collect()} == {(0, 98, 99, 1.5, 1), (0, 0, 100, 0.0, 0)} and names.count() == 1
    assert {r["state"]: r["final_weight"] for r in f.states.collect()} == {0: None, 1: 0.5} and f.meta.first()["start"] == 0
    for bad in (data[:-3], b"1234" + data[4:], vector_file([0.0], [[]], 0, b"const"), vector_file([0.0], [[(1, 1, 0.0, 7)]], 0)):
        with pytest.raises(InvalidFormat):
            binary.parse_vector(bad)


def test_write_binary(spark, tmp_path):
    two = batch([trie(["ab", "c"]).frame(spark, 0), trie(["x"]).frame(spark, 1)])
    told = binary.write_binary(two, str(tmp_path / "out"), suffix=".bin").collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["0.bin", "1.bin"] and sum(r["bytes"] for r in told) == sum(os.path.getsize(tmp_path / "out" / x) for x in ("0.bin", "1.bin"))
    assert isomorphic(Packed.from_bytes((tmp_path / "out" / "1.bin").read_bytes()).machine(), trie(["x"]))


def test_sql_paths_and_sums(spark):
    register_paths(spark)
    register_semiring_sum(spark)
    loop = Machine()
    loop.set_start(loop.add_state())
    loop.set_final(0, 0.5)
    loop.add_arc(0, 98, 99, 1.0, 0)
    spark.createDataFrame([(1, Packed.of(trie(["ab", "c"], [1.0, 2.0])).to_bytes()), (2, Packed.of(loop).to_bytes()), (3, None)], "id int, data binary").createOrReplaceTempView("machines")
    spark.sql("select * from machines where id <> 2").cache().createOrReplaceTempView("finite")
    got = {(bytes(r["istring"]), bytes(r["ostring"]), r["weight"]) for r in spark.sql("select p.* from finite m, lateral fst_paths(m.data, null) p").collect()}
    assert got == {(b"ab", b"ab", 1.0), (b"c", b"c", 2.0)}
    got = {(bytes(r["istring"]), bytes(r["ostring"]), r["weight"]) for r in spark.sql("select p.* from (select * from machines where id = 2) m, lateral fst_paths(m.data, 2) p").collect()}
    assert got == {(b"", b"", 0.5), (b"a", b"b", 1.5), (b"aa", b"bb", 2.5)}
    with pytest.raises(Exception, match="cycle"):
        spark.sql("select p.* from (select * from machines where id = 2) m, lateral fst_paths(m.data, null) p").collect()
    row = spark.sql("select semiring_sum(w, 'log') l, semiring_sum(w, 'tropical') t from values (1.0D), (2.0D), (cast(null as double)) t(w)").first()
    assert abs(row["l"] - 0.686738) < 1e-6 and row["t"] == 1.0


def test_workers_without_the_package(tmp_path):
    """The package reaches workers by value: they have no path to it."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from weftline.functions.machine import trie
from weftline.operators.rewrite import Rule
from weftline.sources import binary
assert binary.decode(binary.encode(trie(["ab"]).frame(spark))).arcs.count() == 2
assert spark.range(1).select(Rule({{"a": "b"}}).kernel(F.lit("cat")).alias("x")).first()["x"] == "cbt"
print("fine")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_long_texts_are_rewritten_in_windows(monkeypatch):
    """A text's pieces are never all in memory: windows end with cut bytes, and the results are those of whole texts."""
    cut = re.compile(b"([ .]+)")
    text = b"the cat.  on the mat " * 50 + b"the" * 20
    parts = list(rewrite.windows(text, cut, 16))
    assert b"".join(parts) == text and len(parts) > 50 and all(p[-1:] in b" ." for p in parts[:-1]) and max(map(len, parts[:-1])) < 32
    assert list(rewrite.windows(b"", cut, 16)) == [b""] and list(rewrite.windows(text, None, 16)) == [text]
    assert [x for p in parts for x in cut.split(p) if x] == [x for x in cut.split(text) if x]
