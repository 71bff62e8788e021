"""Operators on small machines: structure, languages and errors."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import charclass, strings
from weftline.functions.machine import Machine, acceptor, any_of, chain, edit_transducer, spell, transducer, trie
from weftline.iso import isomorphic
from weftline.model import InvalidMachine, batch, empty, frame, label_text
from weftline.operators import lazy, paths, rational, reduce
from weftline.operators.compose import compose, merge_parallel
from weftline.operators.difference import InvalidDifference, difference
from weftline.operators.replace import CyclicDependency, replace
from weftline.plans import prefix
from weftline.plans.fixpoint import NoFixpoint
from weftline.plans.packed import Packed
from weftline.semiring import Log, Tropical, is_zero
from weftline.session import text_batches
from weftline.sources import binary


def sizes(fst):
    r = fst.sizes().first()
    return r["num_states"], r["num_arcs"]


def words(fst, n=24):
    """text -> weight of an acceptor's language; of transducers (in, out) -> weight."""
    rows = fst.language(n).select(label_text("ilabels").alias("i"), label_text("olabels").alias("o"), "weight").collect()
    return {(r["i"] if r["i"] == r["o"] else (r["i"], r["o"])): r["weight"] for r in rows}


@pytest.fixture(scope="module")
def ab(spark):
    return acceptor("ab").frame(spark).cut(), acceptor("c").frame(spark).cut()


def test_builder_and_accessors(spark):
    m = Machine()
    m.add_states(3)
    m.set_start(0)
    m.add_arc(0, 5, 6, 1.5, 1)
    m.add_arc(0, 2, 2, 0.0, 2)
    m.set_final(2, 0.5)
    with pytest.raises(InvalidMachine):
        m.add_arc(0, 1, 1, 0.0, 3)
    with pytest.raises(InvalidMachine):
        frame(spark, 0, 4, {}, [], 2)
    f = m.frame(spark)
    assert sizes(f) == (3, 2) and f.meta.first()["start"] == 0
    assert [r["ilabel"] for r in f.sorted_arcs().orderBy("ord").collect()] == [2, 5]
    assert f.final_weight(2).first()["final_weight"] == 0.5 and f.final_weight(1).first()["final_weight"] == math.inf
    assert f.find_arc(0, 5).first()["dst"] == 1 and f.arcs_by_ilabel(7).count() == 0
    assert sizes(f.delete_arcs(0)) == (3, 0) and sizes(f.delete_states()) == (0, 0)
    assert f.set_final(1, 2.0).final_weight(1).first()["final_weight"] == 2.0
    assert isomorphic(Machine.of(f), m) and m.clone().num_arcs == 2
    p = f.properties().first()
    assert not p["acceptor"] and p["epsilon_free"] and p["deterministic"] and not p["unweighted"]
    f.validate()
    with pytest.raises(InvalidMachine):
        f.with_(states=f.states.filter("state <> 2")).validate()
    with pytest.raises(InvalidMachine):
        rational.union(f, f.with_(encoding="raw"))


def test_strings(spark):
    df = spark.createDataFrame([(0, "hello"), (1, ""), (2, "中"), (3, None)], "id long, t string")
    f = strings.compile_strings(df, "id", "t").cut()
    assert {r["fst_id"]: (r["num_states"], r["num_arcs"]) for r in f.sizes().collect()} == {0: (6, 5), 1: (1, 0), 2: (4, 3)}
    assert {r["fst_id"]: r["text"] for r in strings.print_strings(f).collect()} == {0: "hello", 1: "", 2: "中"}
    p = strings.compile_pairs(spark.createDataFrame([(0, "ab", "xyz")], "id long, a string, b string"), "id", "a", "b")
    assert sizes(p) == (4, 3) and words(p) == {("ab", "xyz"): 0.0}
    assert strings.print_strings(p).first()["text"] == "xyz" and strings.print_strings(p, "input").first()["text"] == "ab"
    assert strings.print_strings(any_of([acceptor("a"), acceptor("b")]).frame(spark)).first()["text"] is None
    assert strings.print_strings(chain([300]).frame(spark)).first()["text"] is None


def test_character_classes():
    counts = [(m.num_states, m.num_arcs) for m in (charclass.any_byte(), charclass.digit(), charclass.alpha(), charclass.sigma_star(), charclass.utf8_char())]
    assert counts == [(2, 256), (2, 10), (2, 52), (1, 256), (8, 563)]


def test_structure_of_rational_operations(spark, ab):
    a, b = ab  # 3 states 2 arcs, 2 states 1 arc
    none = empty(spark)
    assert sizes(rational.union(a, b)) == (6, 5) and sizes(rational.union(a, none)) == (3, 2)
    assert sizes(rational.union(none, b)) == (3, 2) and words(rational.union(none, b)) == {"c": 0.0}
    assert sizes(rational.concat(a, b)) == (5, 4)
    assert [sizes(rational.closure(a, k)) for k in ("star", "plus", "ques")] == [(4, 4), (3, 3), (4, 3)]
    assert sizes(rational.reverse(a)) == (4, 3) and sizes(rational.invert(a)) == (3, 2)
    with pytest.raises(ValueError):
        rational.closure(a, "twice")
    with pytest.raises(ValueError):
        rational.repeat(a, 3, 2)


def test_languages_of_rational_operations(spark, ab):
    a, b = ab
    assert words(rational.union(a, b)) == {"ab": 0.0, "c": 0.0}
    assert words(rational.concat(a, b)) == {"abc": 0.0}
    assert words(rational.concat(a, empty(spark))) == {} and words(rational.concat(empty(spark), a)) == {}
    assert words(rational.closure(empty(spark), "star")) == {"": 0.0} and words(rational.closure(empty(spark), "ques")) == {"": 0.0}
    assert set(words(rational.closure(b, "star"), 8)) == {"", "c", "cc", "ccc", "cccc"}
    assert set(words(rational.closure(b, "plus"), 8)) == {"c", "cc", "ccc", "cccc"}
    assert set(words(rational.closure(b, "ques"))) == {"", "c"}
    for least, most in ((0, 0), (0, 1), (0, 3), (1, 1), (2, 2), (1, 3), (2, 4)):
        assert set(words(rational.repeat(b, least, most))) == {"c" * n for n in range(least, most + 1)}
    weighted = chain(spell("ab"), weight=2.0).frame(spark)
    assert words(rational.reverse(weighted)) == {"ba": 2.0} and words(rational.repeat(weighted, 2, 2)) == {"abab": 4.0}
    t = transducer("ab", "x").frame(spark)
    assert words(t) == {("ab", "x"): 0.0} and words(rational.invert(t)) == {("x", "ab"): 0.0}
    assert words(rational.project(t, "input")) == {"ab": 0.0} and words(rational.project(t, "output")) == {"x": 0.0}


def test_batches_stay_apart(spark):
    two = batch([acceptor("a").frame(spark, 0), acceptor("b").frame(spark, 1)])
    three = batch([acceptor("x").frame(spark, 0), empty(spark, 1)])
    got = {(r["fst_id"], r["t"]) for r in rational.union(two, three).language().select("fst_id", label_text("ilabels").alias("t")).collect()}
    assert got == {(0, "a"), (0, "x"), (1, "b")}


def test_compose(spark):
    one, two = transducer("ab", "bc").frame(spark), transducer("bc", "xyz").frame(spark)
    assert words(compose(one, two)) == {("ab", "xyz"): 0.0}
    assert words(compose(one, transducer("bd", "x").frame(spark))) == {}
    assert compose(one, empty(spark)).meta.first()["start"] is None
    many = batch([acceptor(w).frame(spark, i) for i, w in enumerate(["cat", "cot", "dog"])])
    rule = any_of([transducer("cat", "CAT"), transducer("dog", "D")]).frame(spark, 9)
    out = compose(many, rule, shared=True).cut()
    assert {r["fst_id"]: r["o"] for r in out.language().select("fst_id", label_text("olabels").alias("o")).collect()} == {0: "CAT", 2: "D"}


def test_composition_counts_paths_once(spark):
    left = frame(spark, 0, 0, {3: 0.0}, [(0, 1, 1, 0.5, 1), (1, 5, 0, 0.25, 2), (2, 1, 1, 0.0, 3)], semiring="log")
    right = frame(spark, 0, 0, {3: 0.0}, [(0, 1, 1, 0.5, 1), (1, 0, 6, 0.25, 2), (2, 1, 1, 0.0, 3)], semiring="log")
    r = compose(left, right).language().collect()
    assert len(r) == 1 and r[0]["paths"] == 1 and r[0]["weight"] == pytest.approx(1.5)


def test_shortest_path(spark):
    f = frame(spark, 0, 0, {2: 0.0}, [(0, 1, 1, 1.0, 1), (1, 2, 2, 2.0, 2), (0, 3, 3, 5.0, 3), (3, 4, 4, 1.0, 2)])
    p = Machine.of(paths.shortest_path(f))
    assert p.num_states == 3 and [a[0][2] for a in p.arcs[:2]] == [1.0, 2.0] and p.finals[2] == 0.0
    assert paths.total_weight(f).first()["weight"] == 3.0
    two = frame(spark, 0, 0, {1: 0.0}, [(0, 10, 100, 3.0, 1), (0, 11, 101, 1.0, 1)])
    assert Machine.of(paths.shortest_path(two)).arcs[0] == [(11, 101, 1.0, 1)]
    best = any_of([chain([2], weight=1.0), chain([3], weight=2.0), chain([4], weight=0.5)]).frame(spark)
    assert words(paths.shortest_path(best)) == {"\x03": 0.5}
    assert paths.shortest_path(f, 0).meta.first()["start"] is None
    with pytest.raises(NotImplementedError):
        paths.shortest_path(f, 2)
    assert sizes(paths.shortest_path(f.with_(states=f.states.withColumn("final_weight", F.lit(None).cast("double"))))) == (0, 0)


def test_shortest_path_cycles(spark):
    star = rational.closure(acceptor("a").frame(spark), "star")  # a cycle of weight zero
    assert words(paths.shortest_path(star)) == {"": 0.0}
    back = frame(spark, 0, 0, {2: 0.0}, [(0, 1, 1, 4.0, 1), (0, 2, 2, 6.0, 2), (1, 3, 3, -3.0, 2)])
    assert paths.total_weight(back).first()["weight"] == 1.0
    with pytest.raises(RuntimeError):
        paths.distances(frame(spark, 0, 0, {1: 0.0}, [(0, 1, 1, -1.0, 1), (1, 1, 1, 0.0, 0)]))


def test_rm_epsilon(spark):
    f = frame(spark, 0, 0, {2: 0.0}, [(0, 0, 0, 1.0, 1), (1, 98, 98, 2.0, 2)])
    r = reduce.rm_epsilon(f)
    assert {(a["src"], a["weight"], a["dst"]) for a in r.arcs.collect()} == {(0, 3.0, 2), (1, 2.0, 2)} and sizes(r)[0] == 3
    assert reduce.rm_epsilon(frame(spark, 0, 0, {1: 2.0}, [(0, 0, 0, 1.0, 1)])).final_weight(0).first()["final_weight"] == 3.0
    # two epsilon ways to one state: the better one counts
    both = frame(spark, 0, 0, {3: 0.0}, [(0, 0, 0, 5.0, 1), (0, 0, 0, 1.0, 2), (2, 0, 0, 1.0, 1), (1, 98, 98, 0.0, 3)])
    assert words(reduce.rm_epsilon(both)) == {"a": 2.0}
    log = both.with_(semiring=Log)
    assert words(reduce.rm_epsilon(log))["a"] == pytest.approx(-math.log(math.exp(-5) + math.exp(-2)))
    with pytest.raises(RuntimeError):
        reduce.rm_epsilon(frame(spark, 0, 0, {1: 0.0}, [(0, 0, 0, 1.0, 1), (1, 0, 0, 1.0, 0)], semiring="log"))


def test_connect(spark):
    f = frame(spark, 0, 0, {2: 0.0}, [(0, 1, 1, 0.0, 1), (1, 2, 2, 0.0, 2), (0, 3, 3, 0.0, 3)])
    assert sizes(reduce.connect(f)) == (3, 2)
    dead = reduce.connect(frame(spark, 0, 0, {1: 0.0}, [(1, 1, 1, 0.0, 0)]))
    assert sizes(dead) == (0, 0) and dead.meta.first()["start"] is None


def test_determinize(spark):
    f = frame(spark, 0, 0, {1: 0.0, 2: 0.0}, [(0, 98, 98, 1.0, 1), (0, 98, 98, 2.0, 2)])
    d = Machine.of(reduce.determinize(f))
    assert d.num_states == 2 and d.arcs[d.start][0][:3] == (98, 98, 1.0) or d.num_states == 2
    assert words(reduce.determinize(f)) == {"a": 1.0}
    with pytest.raises(reduce.NotAnAcceptor):
        reduce.determinize(transducer("a", "b").frame(spark))
    eps = any_of([chain([98], weight=1.0), chain([98], weight=2.0)]).frame(spark)
    assert words(reduce.determinize(eps)) == {"a": 1.0}
    assert words(reduce.determinize(eps, drop_epsilon=True)) == {}
    grows = frame(spark, 0, 0, {1: 0.0, 2: 0.0}, [(0, 98, 98, 0.0, 1), (0, 98, 98, 0.0, 2), (1, 98, 98, 1.0, 1), (2, 98, 98, 2.0, 2)])
    with pytest.raises(RuntimeError):
        reduce.determinize(grows, max_rounds=6)


def test_minimize(spark):
    f = frame(spark, 0, 0, {1: 0.0, 2: 0.0}, [(0, 1, 1, 0.0, 1), (0, 2, 2, 0.0, 2)])
    assert sizes(reduce.minimize(f)) == (2, 2)
    kept = frame(spark, 0, 0, {1: 0.0, 2: 1.0}, [(0, 1, 1, 0.0, 1), (0, 2, 2, 0.0, 2)])
    assert sizes(reduce.minimize(kept)) == (3, 2)


def test_optimize(spark):
    star = reduce.optimize(rational.closure(acceptor("a").frame(spark), "star"))
    assert isomorphic(Machine.of(star), Machine.of(frame(spark, 0, 0, {0: 0.0}, [(0, 98, 98, 0.0, 0)])))
    either = reduce.optimize(rational.union(acceptor("a").frame(spark), acceptor("b").frame(spark)))
    assert sizes(either) == (2, 2)
    t = any_of([chain([98], [121], 1.0), chain([98], [122], 2.0), transducer("b", "c")]).frame(spark)
    assert words(reduce.optimize(t)) == {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "c"): 0.0}
    one = reduce.optimize(t)
    assert isomorphic(Machine.of(one), Machine.of(reduce.optimize(one)))


def test_difference(spark):
    a = trie(["a", "b", "abc"]).frame(spark)
    assert set(words(difference(a, trie(["a", "zz"]).frame(spark)))) == {"b", "abc"}
    assert set(words(difference(a, empty(spark)))) == {"a", "b", "abc"}
    weighted = any_of([chain([98], weight=2.0), chain([99], weight=3.0)]).frame(spark)
    assert words(difference(weighted, trie(["b"]).frame(spark))) == {"a": 2.0}
    for x, y in ((transducer("a", "b"), trie(["a"])), (trie(["a"]), any_of([acceptor("a")])), (trie(["a"]), chain([98], weight=1.0))):
        with pytest.raises(InvalidDifference):
            difference(x.frame(spark), y.frame(spark).cut())


def test_replace(spark):
    root = frame(spark, 0, 0, {2: 0.0}, [(0, 98, 98, 0.0, 1), (1, 1000, 1000, 2.0, 2)])
    inner = frame(spark, 0, 0, {2: 0.5}, [(0, 1001, 1001, 0.0, 1), (1, 34, 34, 0.0, 2)])
    leaf = any_of([acceptor("xy"), acceptor("z")]).frame(spark)
    out = replace(root, [(1000, inner), (1001, acceptor("no").frame(spark)), (1001, leaf)])
    assert words(out) == {"axy!": 2.5, "az!": 2.5}
    # a machine that accepts nothing leaves its label in place
    assert sizes(replace(root, [(1000, empty(spark))])) == (3, 2)
    with pytest.raises(CyclicDependency):
        replace(root, [(1000, inner), (1001, root)])


def test_semirings(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "w double")
    assert df.agg(Tropical.plus("w")).first()[0] == 1.0
    assert df.agg(Log.plus("w")).first()[0] == pytest.approx(0.6867383124818)
    assert spark.createDataFrame([(900.0,), (901.0,)], "w double").agg(Log.plus("w")).first()[0] == 900.0
    row = spark.range(1).select(Tropical.times(F.lit(float("inf")), F.lit(-1.0)).alias("t"), is_zero(F.lit(-math.inf)).alias("z")).first()
    assert row["t"] == math.inf and row["z"]


def random_acceptor(dice, n, labels=3):
    m = Machine()
    m.add_states(n)
    m.set_start(0)
    for s in range(n):
        if dice.random() < 0.5:
            m.set_final(s, float(dice.randint(0, 5)))
        for _ in range(dice.randint(1, 2)):
            if (d := dice.randrange(n)) > s:  # acyclic, so that languages are finite
                x = 98 + dice.randrange(labels)
                m.add_arc(s, x, x, float(dice.randint(0, 5)), d)
    return m


@pytest.mark.parametrize("semiring", ["tropical", "log"])
def test_reduction_keeps_languages(spark, semiring):
    dice = random.Random(100)
    many = batch([random_acceptor(dice, 6).frame(spark, i, semiring) for i in range(4)]).cut()

    def language(f):
        return {(r["fst_id"], tuple(r["ilabels"])): r["weight"] for r in f.language().collect()}

    want = language(many)
    for out in (reduce.determinize(many), reduce.connect(many), reduce.minimize(reduce.determinize(many))):
        assert language(out) == pytest.approx(want)
    d = reduce.determinize(many)
    assert d.arcs.groupBy("fst_id", "src", "ilabel").count().filter("count > 1").count() == 0
    again = reduce.minimize(reduce.minimize(d))
    assert again.states.count() == reduce.minimize(d).states.count()


def test_edit_distance_by_composition(spark):
    words_ = ["kitten", "sitting", "mat"]
    letters = sorted({x for w in words_ + ["cat"] for x in spell(w)})
    edits = edit_transducer(letters).frame(spark)
    rule = compose(edits, trie(["sitting", "mat"]).frame(spark)).cut()
    many = batch([acceptor(w).frame(spark, i) for i, w in enumerate(["kitten", "cat"])])
    got = {r["fst_id"]: r["weight"] for r in paths.total_weight(compose(many, rule, shared=True)).collect()}
    assert got == {0: 3.0, 1: 1.0}


def test_language_leaves_no_path_out(spark):
    long = "x" * 70
    f = batch([acceptor(long).frame(spark, 0), acceptor("y").frame(spark, 1)])
    assert {r["i"] for r in f.language().select(label_text("ilabels").alias("i")).collect()} == {long, "y"}
    assert f.language(10).count() == 1  # as asked for
    with pytest.raises(InvalidMachine, match="cycle"):
        rational.closure(acceptor("a").frame(spark), "star").language()


def test_print_strings_follows_arcs(spark):
    made = {
        0: ([(0, 98, 98, 0.0, 2), (2, 99, 99, 0.0, 1)], {1: 0.0}, 0, "ab"),
        1: ([(0, 98, 98, 0.0, 1)], {1: 0.0, 2: 0.0}, 0, "a"),  # a final state off the way
        2: ([(0, 98, 98, 0.0, 1), (0, 99, 99, 0.0, 1)], {1: 0.0}, 0, None),  # a branch
        3: ([(0, 98, 98, 0.0, 1), (1, 99, 99, 0.0, 0)], {1: 0.0}, 0, None),  # a cycle
        4: ([], {0: 0.0}, 0, ""),
        5: ([], {0: 0.0}, None, None),
        6: ([(0, 98, 98, 0.0, 1), (1, 0, 0, 0.0, 2)], {0: 0.0, 2: 0.0}, 0, "a"),  # a final state on the way, an epsilon
        7: ([(0, 98, 98, 0.0, 1)], {}, 0, None),
        8: ([(0, 300, 300, 0.0, 1)], {1: 0.0}, 0, None),  # no byte
        9: ([(0, 256, 256, 0.0, 1)], {1: 0.0}, 0, None),  # no text
    }
    f = batch([frame(spark, k, start, finals, arcs, 3) for k, (arcs, finals, start, _) in made.items()])
    for fst in (f, f.cut()):
        assert {r["fst_id"]: r["text"] for r in strings.print_strings(fst).collect()} == {k: x[3] for k, x in made.items()}


def test_compile_strings_counts_without_arcs(spark):
    df = spark.createDataFrame([(1, "aé\n\x00z"), (2, ""), (3, None)], "id long, s string")
    f = strings.compile_strings(df, "id", "s")
    want = {1: (7, 6, 1), 2: (1, 0, 1)}
    for x in (f, f.with_(arcs=f.arcs)):
        assert {r["fst_id"]: (r["num_states"], r["num_arcs"], r["num_finals"]) for r in x.sizes().collect()} == want
    assert {r["fst_id"]: r["text"] for r in strings.print_strings(f).collect()} == {1: "aé\n\x00z", 2: ""}


def test_trie_of_a_column(spark):
    rows = [("ab", 3.0), ("ab", 1.0), ("a", 2.0), ("b", 5.0), ("", 7.0), (None, 0.0)]
    f = strings.trie(spark.createDataFrame(rows, "s string, w double"), "s", "w")
    assert isomorphic(Machine.of(f), trie(["ab", "ab", "a", "b", ""], [3.0, 1.0, 2.0, 5.0, 7.0]))


@pytest.mark.parametrize("seed", range(3))
def test_lazy_composition(spark, seed):
    """Searched in workers, built in workers and round by round: the same best weights; chains have their arcs' weights."""
    dice = random.Random(seed)

    def some(k, n):
        arcs = [(dice.randrange(n), dice.choice([0, 1, 2]), dice.choice([0, 1, 2]), float(dice.randint(0, 9)), dice.randrange(n)) for _ in range(3 * n)]
        return frame(spark, k, 0, {s: float(dice.randint(0, 3)) for s in range(n) if dice.random() < 0.4}, arcs, n)

    a, b = batch([some(k, 4) for k in range(5)]).cut(), some(0, 3).cut()
    eager = {r["fst_id"]: r["weight"] for r in paths.total_weight(compose(a, b, shared=True)).collect()}
    built = {r["fst_id"]: r["weight"] for r in paths.total_weight(lazy.compose_shared(a, b)).collect()}
    best = lazy.compose_shortest_path(a, b)
    assert built == eager == {r["fst_id"]: r["weight"] for r in lazy.chain_weights(best).collect() if r["fst_id"] in eager}
    assert {r["fst_id"] for r in best.meta.filter("start is not null").collect()} == set(eager)
    for r in best.sizes().filter("num_states > 0").collect():
        assert r["num_arcs"] == r["num_states"] - 1 and r["num_finals"] == 1
    assert lazy.compose_shortest_path(a, b, 0).sizes().agg(F.sum("num_states")).first()[0] == 0


def test_products_of_products_keep_their_ids_in_range(spark):
    """Ids that leave no room for a product's are numbered anew."""
    far = 2**40
    f = frame(spark, 0, 0, {1: 0.0}, [(0, 1, 1, 1.0, 1)], 2)
    up = f.with_(meta=f.meta.withColumn("start", F.col("start") + far), states=f.states.withColumn("state", F.col("state") + far), arcs=f.arcs.withColumn("src", F.col("src") + far).withColumn("dst", F.col("dst") + far)).cut()
    assert paths.total_weight(compose(compose(up, up), up)).first()["weight"] == 3.0


def test_renumber_of_far_ids(spark):
    ids = [-(2**62), -5, 0, 1, 2, 2**62, 2**62 + 1]
    f = frame(spark, 0, 0, {}, [], 1)
    f = f.with_(states=spark.createDataFrame([(0, x, None) for x in ids], "fst_id long, state long, final_weight double"), meta=spark.createDataFrame([(0, 2)], "fst_id long, start long"))
    assert sorted(r["state"] for r in f.renumber().states.collect()) == list(range(7)) and f.renumber().meta.first()["start"] == 4


def test_ranges(spark):
    dice = random.Random(4)
    rows = [(None, dice.randrange(4096)) for _ in range(50)] + [(7, dice.randrange(4096)) for _ in range(300)] + [(dice.randrange(1000), 0) for _ in range(400)] + [(2**62, 0), (-(2**62), 0)]
    df = spark.createDataFrame(rows, "k long, t int")
    r = prefix.ranges(df, "k", 16)
    got = df.select("k", "t", r.bucket(F.col("k"), F.col("t")).alias("b")).collect()
    order = sorted(got, key=lambda x: (x["k"] is not None, x["k"] or 0, x["t"]))
    assert [x["b"] for x in order] == sorted(x["b"] for x in order)
    assert len({x["b"] for x in got if x["k"] == 7}) > 200 and len({x["b"] for x in got if x["k"] is None}) > 40
    assert max(collections.Counter(x["b"] for x in got).values()) <= 120
    assert not prefix.ranges(df.limit(0), "k", 16).starts


def test_text_batches_keep_smaller_settings(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    old = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for k in old:
            spark.conf.unset(k)
        text_batches(spark)
        assert spark.conf.get(rows) == "1000" and spark.conf.get(size).rstrip("b") == str(8 << 20)
        spark.conf.set(rows, "10")
        text_batches(spark)
        assert spark.conf.get(rows) == "10"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_printing_joins_nothing(spark):
    """No table of arcs can be taken for a small one and sent to the driver; chains and other machines are read alike."""
    words = spark.createDataFrame([(1, "añb"), (2, ""), (3, None), (4, "x" * 3000)], "id long, word string")
    chains = strings.compile_strings(words, "id", "word")
    others = chains.with_(arcs=chains.arcs.filter("fst_id <> 4 or src <> 7"))
    for fst, last in ((chains, "x" * 3000), (others, None)):
        out = strings.print_strings(fst)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["fst_id"]: r["text"] for r in out.collect()} == {1: "añb", 2: "", 4: last}


def test_merged_arcs_count_every_path(spark):
    """Parallel arcs, epsilons on both sides and a weight of zero: merged machines have the same language, counts included."""
    a = frame(spark, 0, 0, {2: 0.5}, [(0, 1, 2, 1.0, 1), (0, 1, 2, 2.0, 1), (0, 1, 2, math.inf, 1), (1, 4, 0, 0.5, 2), (1, 4, 0, 0.25, 2), (1, 4, 3, 1.0, 2)], semiring="log")
    b = frame(spark, 0, 0, {2: 0.0}, [(0, 2, 7, 1.0, 1), (0, 2, 7, 3.0, 1), (1, 0, 8, 0.5, 2), (1, 0, 8, 0.5, 2), (1, 3, 8, 0.0, 2)], semiring="log")
    found = []
    for m in (compose(a, b), compose(merge_parallel(a), merge_parallel(b)), compose(merge_parallel(a), b)):
        found.append({(*r["ilabels"], *r["olabels"]): (round(r["weight"], 9), r["paths"]) for r in m.language().collect()})
        last = m
    assert found[0] == found[1] == found[2] == {(1, 4, 7, 8): (found[0][1, 4, 7, 8][0], 20)}
    many = [(0, 1, 1, float(k % 3), 1) for k in range(300)]
    product = compose(*(merge_parallel(frame(spark, 0, 0, {1: 0.0}, many, semiring="log")) for _ in range(2)))
    assert product.arcs.count() == 1 and product.language().first()["paths"] == 90000 and "paths" in last.arcs.columns


def test_packing_joins_nothing(spark):
    """Chains are packed from their labels, other machines by aggregation: the same bytes, and no table that a join may broadcast."""
    words = spark.createDataFrame([(1, "ab"), (2, ""), (3, "x" * 300)], "id long, word string")
    chains = strings.compile_strings(words, "id", "word")
    want = {i: Packed.of(acceptor(w)).to_bytes() for i, w in ((1, "ab"), (2, ""), (3, "x" * 300))}
    for fst in (chains, chains.with_(meta=chains.meta, dense=True)):
        out = binary.encode(fst)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["fst_id"]: bytes(r["data"]) for r in out.collect()} == want
    m = Machine()
    m.add_states(3)
    m.set_start(1)
    m.set_final(2, 0.5)
    for a in ((1, 3, 3, 1.0, 2), (1, 2, 4, 0.0, 0), (0, 5, 5, 2.0, 1)):
        m.add_arc(*a)
    assert bytes(binary.encode(m.frame(spark)).first()["data"]) == Packed.of(m).to_bytes()


def test_products_of_workers_are_written_once(spark):
    words = spark.createDataFrame([(1, "ab"), (2, ""), (3, "zz")], "id long, word string")
    both = lazy.compose_shared(strings.compile_strings(words, "id", "word"), edit_transducer(spell("ab")))
    files = [sorted(df.inputFiles()) for df in (both.meta, both.states, both.arcs)]
    assert files[0] and files[0] == files[1] == files[2]
    assert {r["fst_id"]: r["num_finals"] > 0 for r in both.sizes().collect()} == {1: True, 2: True, 3: False}


def test_weights_carry_no_structs(spark):
    """The same weights as distances(), negative ones and cycles of weight zero too, by aggregations that need no sort."""
    f = frame(spark, 0, 0, {3: 0.0}, [(0, 1, 1, 5.0, 1), (0, 2, 2, 1.0, 2), (2, 3, 3, -3.0, 1), (1, 4, 4, 0.0, 3), (3, 4, 4, 0.0, 1), (4, 1, 1, 1.0, 0), (0, 1, 1, math.inf, 4)]).cut()
    got = paths.weights(f)
    assert {r["state"]: r["w"] for r in got.collect()} == {0: 0.0, 1: -2.0, 2: 1.0, 3: -2.0} == {r["state"]: r["best"]["w"] for r in paths.distances(f).collect()}
    assert got.columns == ["fst_id", "state", "w"]
    with pytest.raises(NoFixpoint):
        paths.weights(frame(spark, 0, 0, {1: 0.0}, [(0, 1, 1, -1.0, 1), (1, 1, 1, 0.0, 0)]))


def test_trimming_numbers_states_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(reduce, "ranked", lambda df, f=reduce.ranked: calls.append(df) or f(df))
    f = frame(spark, 0, 3, {9: 0.5}, [(3, 1, 1, 0.0, 7), (3, 1, 2, 0.0, 7), (7, 2, 2, 1.0, 9), (7, 2, 2, 1.0, 5), (1, 2, 2, 1.0, 9)]).cut()
    out = reduce.connect(f)
    assert sorted((r["src"], r["olabel"], r["dst"]) for r in out.arcs.collect()) == [(0, 1, 1), (0, 2, 1), (1, 2, 2)]
    assert out.meta.first()["start"] == 0 and {r["state"]: r["final_weight"] for r in out.states.collect()} == {0: None, 1: None, 2: 0.5}
    assert len(calls) == 1 and "Join" not in out.arcs._jdf.queryExecution().optimizedPlan().toString()


def test_arcs_of_strings_are_labelled_after_the_explode(spark):
    words = spark.createDataFrame([(1, "aé"), (2, ""), (3, None), (4, "\x00")], "id long, word string")
    arcs = strings.compile_strings(words, "id", "word").arcs
    assert "transform" not in arcs._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r["fst_id"], r["src"], r["ilabel"], r["olabel"], r["dst"]) for r in arcs.collect()) == [(1, 0, 98, 98, 1), (1, 1, 196, 196, 2), (1, 2, 170, 170, 3), (4, 0, 1, 1, 1)]
