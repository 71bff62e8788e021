"""The engine's queries over the driver tables, each with its SQL oracle.

Machines come from the tables: P, the part names as a lexicon; N, the graph of supplier nations and customer nations
with whole-number weights; chains of documents, conversations and events; label relations of customers and nations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import charclass, strings
from weftline.convert import convert
from weftline.functions import sql as sql_functions
from weftline.functions.machine import Machine, edit_transducer, spell
from weftline.model import Fst, batch, frame, label_text
from weftline.operators import lazy, paths, rational, reduce, rewrite
from weftline.operators.compose import compose, intersect, merge_parallel
from weftline.operators.difference import difference
from weftline.operators.replace import CyclicDependency, replace
from weftline.plans import packed
from weftline.semiring import Log, Tropical
from weftline.session import materialise, shared_dir
from weftline.sources import att, binary, symbols
from weftline.streaming.apply import follow, rewrite_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# sources of machines

BYTES = "list_transform(regexp_extract_all(hex({0}), '..'), lambda x: CAST('0x' || x AS BIGINT) + 1)"
N_SQL = """n AS (
  SELECT s.s_nationkey AS src, c.c_nationkey AS dst, CAST(min(l.l_quantity + 3 * l.l_linenumber) AS BIGINT) AS w
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY ALL)"""


def lexicon(df: DataFrame, col: str) -> Fst:
    """The strings of a column, of any number, as a deterministic machine."""
    return strings.trie(df, col)


def letters_of(*columns: DataFrame) -> list[int]:
    """The labels of the bytes that occur in columns of strings: 256 at most."""
    every = columns[0]
    for c in columns[1:]:
        every = every.union(c)
    text = every.columns[0]
    found = every.filter(F.octet_length(text) > 0).select(F.explode(F.array_distinct(strings.byte_labels(F.col(text)))).alias("l")).distinct()
    return sorted(r["l"] for r in found.collect())


def nation_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, w of N."""
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    x = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    return x.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.min(F.col("l_quantity") + 3 * F.col("l_linenumber")).alias("w"))


def nation_machine(spark: SparkSession, sf: str, label=None, final=None, weight=None, semiring=Tropical) -> Fst:
    """N with start 0; labels dst + 1 on both tapes and all states final, unless said otherwise."""
    zero = F.lit(0).cast("long")
    label = F.col("dst") + 1 if label is None else label
    arcs = nation_arcs(spark, sf).select(zero.alias("fst_id"), "src", label.alias("ilabel"), label.alias("olabel"), (F.col("w") if weight is None else weight).cast("double").alias("weight"), "dst")
    states = table(spark, sf, "nation").select(zero.alias("fst_id"), F.col("n_nationkey").cast("long").alias("state"))
    states = states.select("fst_id", "state", (F.lit(0.0) if final is None else final).alias("final_weight"))
    meta = spark.range(1).select(zero.alias("fst_id"), zero.alias("start"))
    return Fst(meta, states, arcs, semiring).cut("nations")


def relation(df: DataFrame, i: str, o: str, w: str) -> Fst:
    """A machine of two states with an arc for each row."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    spark = df.sparkSession
    arcs = df.select(zero.alias("fst_id"), zero.alias("src"), F.col(i).cast("long").alias("ilabel"), F.col(o).cast("long").alias("olabel"), F.col(w).cast("double").alias("weight"), one.alias("dst"))
    f = frame(spark, 0, 0, {1: 0.0}, [], 2)
    return f.with_(arcs=arcs)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's name and its region's."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def words_of(fst: Fst, max_arcs: int | None = None) -> DataFrame:
    """text, weight of an acceptor's language, by paths of any length if max_arcs isn't given."""
    return fst.language(max_arcs).select(label_text("ilabels").alias("text"), "weight")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


# strings, characters, symbols


@query(f"SELECT unnest({BYTES.format('text')}) AS label, count(*) AS n FROM documents GROUP BY 1")
def compile_string_stats(spark, sf):
    fst = strings.compile_strings(table(spark, sf, "documents"), "doc_id", "text")
    return fst.arcs.groupBy(F.col("ilabel").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS fst_id, strlen(text) + 1 AS num_states, strlen(text) AS num_arcs, 1 AS num_finals FROM documents WHERE text IS NOT NULL")
def num_states_arcs(spark, sf):
    return strings.compile_strings(table(spark, sf, "documents"), "doc_id", "text").sizes()


@query("SELECT conv_id * 1000 + turn AS fst_id, text FROM conversations WHERE text IS NOT NULL")
def print_roundtrip(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return strings.print_strings(strings.compile_strings(turns, "id", "text"))


def _pairs_sql(select: str) -> str:
    return f"""
WITH b AS (
  SELECT n_nationkey, {BYTES.format('n_name')} AS a, {BYTES.format('r_name')} AS b
  FROM nation JOIN region ON n_regionkey = r_regionkey
), z AS (SELECT n_nationkey, unnest(list_zip(a, b)) AS z, unnest(range(greatest(len(a), len(b)))) AS p FROM b),
t AS (SELECT CAST(n_nationkey AS BIGINT) AS fst_id, p AS src, coalesce(z[1], 0) AS i, coalesce(z[2], 0) AS o, p + 1 AS dst FROM z)
SELECT fst_id, src, {select}, dst FROM t"""


@query(_pairs_sql("i AS ilabel, o AS olabel"))
def string_transducer(spark, sf):
    return strings.compile_pairs(pairs(spark, sf), "n_nationkey", "n_name", "r_name").arcs.select("fst_id", "src", "ilabel", "olabel", "dst")


@query(_pairs_sql("o AS ilabel, i AS olabel"))
def invert(spark, sf):
    return rational.invert(strings.compile_pairs(pairs(spark, sf), "n_nationkey", "n_name", "r_name")).arcs.select("fst_id", "src", "ilabel", "olabel", "dst")


@query(_pairs_sql("i AS ilabel, i AS olabel"))
def project_input(spark, sf):
    return rational.project(strings.compile_pairs(pairs(spark, sf), "n_nationkey", "n_name", "r_name"), "input").arcs.select("fst_id", "src", "ilabel", "olabel", "dst")


@query(_pairs_sql("o AS ilabel, o AS olabel"))
def project_output(spark, sf):
    return rational.project(strings.compile_pairs(pairs(spark, sf), "n_nationkey", "n_name", "r_name"), "output").arcs.select("fst_id", "src", "ilabel", "olabel", "dst")


@query("SELECT CAST(n_nationkey AS BIGINT) AS fst_id, r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def print_output(spark, sf):
    return strings.print_strings(strings.compile_pairs(pairs(spark, sf), "n_nationkey", "n_name", "r_name"), "output")


def _class_query(name: str, make: Callable[[], Machine], source: str, col: str, sql: str) -> None:
    def run(spark, sf):
        words = table(spark, sf, source).select(F.expr(col).cast("string").alias("word")).groupBy("word").count()
        return words.filter(rewrite.accepts(F.col("word"), make()))

    query(f"SELECT * FROM (SELECT CAST({col} AS VARCHAR) AS word, count(*) AS count FROM {source} GROUP BY 1) WHERE regexp_full_match(word, '{sql}', 's')", name)(run)


_class_query("char_class_digit", charclass.digit, "part", "p_size", "[0-9]")
_class_query("char_class_alpha", charclass.alpha, "orders", "o_orderstatus", "[A-Za-z]")
_class_query("char_class_byte", charclass.any_byte, "lineitem", "l_returnflag", "[\\x00-\\x7f]")
_class_query("char_class_sigma_star", charclass.sigma_star, "customer", "c_mktsegment", ".*")


@query("SELECT role, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def utf8_accept(spark, sf):
    """Every text is a sequence of UTF-8 characters."""
    m = charclass.utf8_char()
    m.add_arc(1, 0, 0, 0.0, 0)  # plus
    m.finals[0] = 0.0
    turns = table(spark, sf, "conversations").filter(rewrite.accepts(F.col("text"), m))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 0 AS label, '<eps>' AS symbol UNION ALL
SELECT row_number() OVER (ORDER BY first, event_type), event_type FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)""")
def symbol_table(spark, sf):
    return symbols.symbol_table(table(spark, sf, "events"), "event_type", "event_id")


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY min(event_id), event_type) AS label, event_type FROM events GROUP BY event_type)
SELECT event_id, label FROM events JOIN s USING (event_type)""")
def symbol_lookup(spark, sf):
    e = table(spark, sf, "events")
    return symbols.with_labels(e, symbols.symbol_table(e, "event_type", "event_id"), "event_type").select("event_id", "label")


# text and binary forms, accessors: over N


@query(f"""WITH {N_SQL},
a AS (SELECT src <> 0 AS later, src AS s, row_number() OVER (PARTITION BY src ORDER BY dst) AS o, concat_ws(chr(9), src, dst, dst + 1, dst + 1, CASE WHEN w <> 0 THEN w END) AS value FROM n),
f AS (SELECT n_nationkey <> 0 AS later, n_nationkey AS s, CAST(n_nationkey AS VARCHAR) AS value FROM nation),
u AS (SELECT 0 AS part, later, s, o, value FROM a UNION ALL SELECT 1, later, s, 0, value FROM f)
SELECT row_number() OVER (ORDER BY part, later, s, o) AS line_no, value FROM u""")
def att_write(spark, sf):
    return att.att_lines(nation_machine(spark, sf)).select("line_no", "value")


@query(f"WITH {N_SQL} SELECT src, dst + 1 AS ilabel, dst + 1 AS olabel, CAST(w AS DOUBLE) AS weight, dst FROM n")
def att_read(spark, sf):
    lines = att.att_lines(nation_machine(spark, sf))
    return att.parse_lines(lines).arcs.drop("fst_id")


@query(f"WITH {N_SQL} SELECT src, dst + 2 AS ilabel, dst + 2 AS olabel, CAST(w AS DOUBLE) AS weight, dst FROM n")
def att_read_shifted(spark, sf):
    return att.parse_lines(att.att_lines(nation_machine(spark, sf)), label_shift=1).arcs.drop("fst_id")


USERS_SQL = """e AS (SELECT user_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS label,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)"""


def user_machines(spark: SparkSession, sf: str) -> Fst:
    """U: a chain of event labels for each user."""
    label = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("fst_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", label.alias("l")))).alias("x"))
    return strings._linear(e.select("fst_id", F.transform("x", lambda v: F.struct(v["l"].alias("ilabel"), v["l"].alias("olabel"))).alias("labels"), F.size("x").alias("n")))


@query(f"WITH {USERS_SQL} SELECT user_id AS fst_id, p AS src, label AS ilabel, label AS olabel, CAST(0 AS DOUBLE) AS weight, p + 1 AS dst FROM e")
def binary_roundtrip(spark, sf):
    data = binary.encode(user_machines(spark, sf))
    return binary.decode(data).arcs


@query(f"WITH {USERS_SQL} SELECT user_id AS fst_id, 24 + 16 * (count(*) + 1) + 24 * count(*) AS bytes FROM e GROUP BY 1")
def binary_size(spark, sf):
    return binary.encode(user_machines(spark, sf)).select("fst_id", F.length("data").cast("long").alias("bytes"))


@query(f"WITH {USERS_SQL} SELECT user_id AS fst_id, 0 AS start, count(*) + 1 AS states, count(*) AS arcs, CAST(count(*) AS INT) AS last_offset FROM e GROUP BY 1")
def freeze(spark, sf):
    p = packed.freeze(user_machines(spark, sf))
    return p.select("fst_id", "start", F.size("finals").cast("long").alias("states"), F.size("arcs").cast("long").alias("arcs"), F.element_at("offsets", -1).alias("last_offset"))


@query(f"WITH {N_SQL} SELECT src, dst + 1 AS ilabel, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INT) AS ord FROM n")
def arc_sort(spark, sf):
    return nation_machine(spark, sf).sorted_arcs().select("src", "ilabel", "ord")


@query(f"WITH {N_SQL} SELECT src, CAST(w AS DOUBLE) AS weight FROM n WHERE dst = 7")
def arcs_by_ilabel(spark, sf):
    return nation_machine(spark, sf).arcs_by_ilabel(8).select("src", "weight")


@query(f"WITH {N_SQL} SELECT 5 AS src, 8 AS ilabel, CAST(w AS DOUBLE) AS weight, dst FROM n WHERE dst = 7 AND src = 5")
def find_arc(spark, sf):
    return nation_machine(spark, sf).find_arc(5, 8).select("src", "ilabel", "weight", "dst")


@query(f"""WITH {N_SQL} SELECT true AS acceptor, true AS epsilon_free, true AS deterministic, bool_and(w = 0) AS unweighted FROM n""")
def properties(spark, sf):
    return nation_machine(spark, sf).properties().drop("fst_id")


@query(f"""WITH {N_SQL} SELECT n_regionkey AS src, dst + 1 AS ilabel, CAST(w AS DOUBLE) AS weight, d.r AS dst
FROM (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1) f JOIN n ON n.src = f.k JOIN (SELECT n_nationkey, n_regionkey AS r FROM nation) d ON d.n_nationkey = n.dst""")
def remap_states(spark, sf):
    """Nations merged into their regions: the first nation's arcs stay."""
    to = table(spark, sf, "nation").select(F.lit(0).cast("long").alias("fst_id"), F.col("n_nationkey").cast("long").alias("state"), F.col("n_regionkey").cast("long").alias("to"))
    return nation_machine(spark, sf).remap(to).arcs.select("src", "ilabel", "weight", "dst")


# rational operations, as languages

FIRST = "split_part(p_name, ' ', 1)"
SECOND = "split_part(p_name, ' ', 2)"


def some_words(spark, sf, col: str, weight: str = "min(p_size)") -> Fst:
    """A lexicon with weights as one machine."""
    w = parts(spark, sf).groupBy(F.expr(col).alias("word")).agg(F.expr(weight).alias("w")).withColumn("id", F.row_number().over(Window.orderBy("word")))
    return strings.any_of_strings(w, "id", "word", "w").cut("words")


@query(f"SELECT text, CAST(min(w) AS DOUBLE) AS weight FROM (SELECT {FIRST} AS text, p_size AS w FROM part UNION ALL SELECT {SECOND}, p_size FROM part) GROUP BY 1")
def union_lang(spark, sf):
    return words_of(rational.union(some_words(spark, sf, FIRST), some_words(spark, sf, SECOND)))


@query(f"""WITH a AS (SELECT {FIRST} AS x, min(p_size) AS v FROM part GROUP BY 1), b AS (SELECT {SECOND} AS y, min(p_size) AS w FROM part GROUP BY 1)
SELECT x || y AS text, CAST(min(v + w) AS DOUBLE) AS weight FROM a, b GROUP BY 1""")
def concat_lang(spark, sf):
    return words_of(rational.concat(some_words(spark, sf, FIRST), some_words(spark, sf, SECOND)))


def initials(spark, sf) -> Fst:
    """The letters with which regions begin, each with the smallest region key as its weight."""
    x = table(spark, sf, "region").groupBy(F.substring("r_name", 1, 1).alias("c")).agg(F.min("r_regionkey").alias("w"))
    rows = sorted((r["c"], r["w"]) for r in x.collect())
    return frame(spark, 0, 0, {1: 0.0}, [(0, ord(c) + 1, ord(c) + 1, w, 1) for c, w in rows], 2)


CHAINS = """WITH RECURSIVE l AS (SELECT substr(r_name, 1, 1) AS c, min(r_regionkey) AS w FROM region GROUP BY 1),
s AS (SELECT '' AS text, CAST(0 AS DOUBLE) AS weight, 0 AS k UNION ALL SELECT s.text || l.c, s.weight + l.w, k + 1 FROM s, l WHERE k < {most})
SELECT text, min(weight) AS weight FROM s WHERE k >= {least} GROUP BY 1"""


def _short(fst: Fst, n: int) -> DataFrame:
    return words_of(fst, 4 * n + 4).filter(F.length("text") <= n)


@query(CHAINS.format(least=0, most=3))
def closure_star_k(spark, sf):
    return _short(rational.closure(initials(spark, sf), "star"), 3)


@query(CHAINS.format(least=1, most=3))
def closure_plus_k(spark, sf):
    return _short(rational.closure(initials(spark, sf), "plus"), 3)


@query(CHAINS.format(least=0, most=1))
def closure_ques(spark, sf):
    return words_of(rational.closure(initials(spark, sf), "ques"))


@query(CHAINS.format(least=2, most=3))
def repeat_2_3(spark, sf):
    return words_of(rational.repeat(initials(spark, sf), 2, 3))


@query(CHAINS.format(least=0, most=2))
def repeat_0_2(spark, sf):
    return words_of(rational.repeat(initials(spark, sf), 0, 2))


@query("SELECT reverse(p_name) AS text, CAST(min(p_size) AS DOUBLE) AS weight FROM part GROUP BY 1")
def reverse_lang(spark, sf):
    return words_of(rational.reverse(some_words(spark, sf, "p_name")))


# composition


@query("""WITH a AS (SELECT 1 + o_orderkey % 100 AS x, o_custkey AS y, floor(o_totalprice) AS v FROM orders),
b AS (SELECT c_custkey AS y, c_nationkey + 1 AS z, floor(abs(c_acctbal)) AS w FROM customer)
SELECT CAST(x AS BIGINT) AS x, CAST(z AS BIGINT) AS z, CAST(min(v + w) AS DOUBLE) AS weight FROM a JOIN b USING (y) GROUP BY 1, 2""")
def compose_pairs(spark, sf):
    """An arc for each order, from its group to its customer, and one for each customer, on to the nation."""
    o = table(spark, sf, "orders").select(F.expr("1 + o_orderkey % 100").alias("x"), F.col("o_custkey").alias("y"), F.expr("floor(o_totalprice)").alias("v"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("y"), F.expr("c_nationkey + 1").alias("z"), F.expr("floor(abs(c_acctbal))").alias("w"))
    out = compose(relation(o, "x", "y", "v"), relation(c, "y", "z", "w"))
    return out.language().select(F.element_at("ilabels", 1).alias("x"), F.element_at("olabels", 1).alias("z"), "weight")


def _epsilon_chain(k: int, side: str) -> list[tuple]:
    """An arc 1:1, k arcs that are silent on one tape, an arc 1:1."""
    silent = [(1 + i, 5, 0, 0.0, 2 + i) if side == "left" else (1 + i, 0, 6, 0.0, 2 + i) for i in range(k)]
    return [(0, 1, 1, 0.0, 1), *silent, (1 + k, 1, 1, 0.0, 2 + k)]


@query("SELECT p * 10 + q AS fst_id, CAST(p + 2 AS INT) AS read, CAST(q + 2 AS INT) AS written, 1 AS paths FROM range(5) a(p), range(5) b(q)")
def compose_eps_filter(spark, sf):
    """However many silent moves both sides have between two matches, one path comes out."""
    grid = [(p, q) for p in range(5) for q in range(5)]
    left = batch([frame(spark, p * 10 + q, 0, {p + 2: 0.0}, _epsilon_chain(p, "left")) for p, q in grid])
    right = batch([frame(spark, p * 10 + q, 0, {q + 2: 0.0}, _epsilon_chain(q, "right")) for p, q in grid])
    out = compose(left.cut("left"), right.cut("right")).cut("product")
    return out.language().select("fst_id", F.size("ilabels").alias("read"), F.size("olabels").alias("written"), "paths")


@query(f"""WITH {USERS_SQL}, s AS (SELECT user_id, string_agg(CAST(label AS VARCHAR), '' ORDER BY p) AS text FROM e GROUP BY 1)
SELECT user_id FROM s WHERE regexp_matches(text, '513')""")
def compose_user_pattern(spark, sf):
    """Users whose events contain view, click, purchase in a row: each user's chain against one acceptor."""
    m = Machine()
    m.add_states(4)
    m.set_start(0)
    m.set_final(3)
    for x in range(1, 6):
        m.add_arc(0, x, x, 0.0, 0)
        m.add_arc(3, x, x, 0.0, 3)
    for i, x in enumerate((5, 1, 3)):
        m.add_arc(i, x, x, 0.0, i + 1)
    both = lazy.compose_shared(user_machines(spark, sf), m)
    return both.states.filter("final_weight is not null").select(F.col("fst_id").alias("user_id")).distinct()


@query(f"SELECT DISTINCT {FIRST} AS text FROM part WHERE {FIRST} IN (SELECT word FROM (SELECT substr({FIRST}, 1, 5) AS word FROM part UNION SELECT {SECOND} FROM part))")
def intersect_lang(spark, sf):
    a = some_words(spark, sf, FIRST, "0")
    b = lexicon(parts(spark, sf).select(F.expr(f"explode(array(substr({FIRST}, 1, 5), {SECOND}))").alias("w")), "w")
    return words_of(intersect(a, b)).select("text")


# paths


@query(f"""WITH RECURSIVE {N_SQL}, d(state, w) USING KEY (state) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT n.dst, min(d.w + n.w) FROM d JOIN n ON n.src = d.state LEFT JOIN recurring.d r ON r.state = n.dst WHERE r.w IS NULL OR d.w + n.w < r.w GROUP BY n.dst
) SELECT state, CAST(w AS DOUBLE) AS weight FROM d""")
def shortest_path_nation(spark, sf):
    return paths.weights(nation_machine(spark, sf)).select("state", F.col("w").alias("weight"))


@query(f"""WITH RECURSIVE {N_SQL}, d(state, w) USING KEY (state) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT n.dst, min(d.w + n.w) FROM d JOIN n ON n.src = d.state LEFT JOIN recurring.d r ON r.state = n.dst WHERE r.w IS NULL OR d.w + n.w < r.w GROUP BY n.dst
) SELECT CAST(min(w + n_nationkey) AS DOUBLE) AS weight FROM d JOIN nation ON state = n_nationkey WHERE n_nationkey >= 20""")
def shortest_path_total(spark, sf):
    """The weight of the best chain, read off the chain itself."""
    final = F.when(F.col("state") >= 20, F.col("state").cast("double"))
    best = paths.shortest_path(nation_machine(spark, sf, final=final))
    both = best.arcs.select("weight").unionByName(best.states.filter("final_weight is not null").select(F.col("final_weight").alias("weight")))
    return both.agg(F.sum("weight").alias("weight"))


def edited(spark, words: DataFrame, names: DataFrame) -> Fst:
    """What each word (id, word) becomes by edits, each of weight 1, over the letters of words and names."""
    letters = letters_of(words.select("word"), names)
    return lazy.compose_shared(strings.compile_strings(words, "id", "word"), edit_transducer(letters))


def _words(spark, sf) -> DataFrame:
    w = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lower("r_name").alias("word"))
    return w.unionByName(spark.createDataFrame([(100, "smal rign")], "id long, word string"))


@query("SELECT word, CAST(min(levenshtein(word, p_name)) AS DOUBLE) AS weight FROM (SELECT lower(r_name) AS word FROM region UNION SELECT 'smal rign') w, (SELECT DISTINCT p_name FROM part) p GROUP BY 1")
def lazy_sp_edit_distance(spark, sf):
    """The nearest name by the best path of word, edits and lexicon; the product with the lexicon is only searched."""
    words, names = _words(spark, sf), parts(spark, sf).select("p_name")
    best = lazy.compose_shortest_path(edited(spark, words, names), lexicon(names, "p_name"))
    return lazy.chain_weights(best).join(words, F.col("fst_id") == F.col("id")).select("word", "weight")


@query("SELECT word, min(p_name) AS name FROM (SELECT word, p_name, levenshtein(word, p_name) AS d, min(levenshtein(word, p_name)) OVER (PARTITION BY word) AS least FROM (SELECT lower(r_name) AS word FROM region UNION SELECT 'smal rign') w, (SELECT DISTINCT p_name FROM part) p) WHERE d = least GROUP BY 1 HAVING count(*) = 1")
def lazy_sp_output(spark, sf):
    """The nearest name itself, read off the chain, where no other name is as near: its weight says so of both."""
    words, names = _words(spark, sf), parts(spark, sf).select("p_name").distinct()
    lexicon_ = lexicon(names, "p_name")
    ways = edited(spark, words, names)
    best = lazy.compose_shortest_path(ways, lexicon_)
    read = strings.print_strings(best).withColumnRenamed("text", "name").join(lazy.chain_weights(best), "fst_id")
    every = names.crossJoin(F.broadcast(words)).select("id", "p_name", F.levenshtein("word", "p_name").cast("double").alias("d"))  # a stated set of words against all names
    alone = read.join(every, read["fst_id"] == every["id"]).filter("d = weight").groupBy("fst_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return alone.join(words, F.col("fst_id") == F.col("id")).select("word", "name")


@query("SELECT lower(r_name) AS word, true AS same FROM region UNION ALL SELECT 'smal rign', true")
def lazy_equals_eager(spark, sf):
    """The best weight by searching the product, and that of the best path of the product itself."""
    words, names = _words(spark, sf), parts(spark, sf).select("p_name")
    ways, names = edited(spark, words, names), lexicon(names, "p_name")
    searched = lazy.chain_weights(lazy.compose_shortest_path(ways, names)).withColumnRenamed("weight", "w")
    eager = paths.total_weight(compose(ways, names, shared=True))
    return searched.join(eager, "fst_id").join(words, F.col("fst_id") == F.col("id")).select("word", (F.col("w") == F.col("weight")).alias("same"))


# a graph that grows: parts that follow each other in an order, with the quantity of the first as weight

PARTS_SQL = """g AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(min(a.l_quantity) AS BIGINT) AS w
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL)"""


def part_graph(spark, sf, where: str = "true", silent: str = "false", final: str = "0.0D") -> Fst:
    """States are part keys, the start is part 1; an arc has its end's key + 1 as label, or none where it is silent."""
    l = table(spark, sf, "lineitem")
    a = l.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("w"))
    b = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    g = a.join(b, ["l_orderkey", "n"]).groupBy("src", "dst").agg(F.min("w").alias("weight")).filter(where)
    zero = F.lit(0).cast("long")
    label = F.when(F.expr(silent), F.lit(0)).otherwise(F.col("dst") + 1).cast("long")
    arcs = g.select(zero.alias("fst_id"), "src", label.alias("ilabel"), label.alias("olabel"), "weight", "dst")
    states = parts(spark, sf).select(zero.alias("fst_id"), F.col("p_partkey").alias("state")).select("fst_id", "state", F.expr(final).alias("final_weight"))
    meta = spark.range(1).select(zero.alias("fst_id"), F.lit(1).cast("long").alias("start"))
    arcs, states = materialise(arcs, "part-arcs"), materialise(states, "part-states")
    return Fst(meta, states, arcs)


@query(f"""WITH RECURSIVE {PARTS_SQL}, d(state, w) USING KEY (state) AS (
  SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT g.dst, min(d.w + g.w) FROM d JOIN g ON g.src = d.state LEFT JOIN recurring.d r ON r.state = g.dst WHERE r.w IS NULL OR d.w + g.w < r.w GROUP BY g.dst
) SELECT state, CAST(w AS DOUBLE) AS weight FROM d""")
def shortest_path_parts(spark, sf):
    return paths.weights(part_graph(spark, sf)).select("state", F.col("w").alias("weight"))


@query(f"""WITH RECURSIVE {PARTS_SQL}, e AS (SELECT src, dst FROM g WHERE w <= 25),
f AS (SELECT CAST(1 AS BIGINT) AS s UNION SELECT e.dst FROM f JOIN e ON e.src = f.s),
b AS (SELECT p_partkey AS s FROM part WHERE p_partkey % 5 = 4 UNION SELECT e.src FROM b JOIN e ON e.dst = b.s),
k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS id FROM f WHERE s IN (SELECT s FROM b))
SELECT x.id AS src, y.s + 1 AS label, y.id AS dst FROM e JOIN k x ON x.s = e.src JOIN k y ON y.s = e.dst""")
def connect_parts(spark, sf):
    return reduce.connect(part_graph(spark, sf, "weight <= 25", final="CASE WHEN state % 5 = 4 THEN 0.0D END")).arcs.select("src", F.col("ilabel").alias("label"), "dst")


@query(f"""WITH RECURSIVE {PARTS_SQL}, x AS (SELECT * FROM g WHERE w <= 1), d(a, b, w) USING KEY (a, b) AS (
  SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION
  SELECT d.a, x.dst, min(d.w + x.w) FROM d JOIN x ON x.src = d.b LEFT JOIN recurring.d r ON r.a = d.a AND r.b = x.dst WHERE r.w IS NULL OR d.w + x.w < r.w GROUP BY d.a, x.dst
) SELECT d.a AS src, g.dst + 1 AS label, CAST(min(d.w + g.w) AS DOUBLE) AS weight, g.dst FROM d JOIN g ON g.src = d.b AND g.w > 1 GROUP BY ALL""")
def rm_epsilon_parts(spark, sf):
    return reduce.rm_epsilon(part_graph(spark, sf, silent="weight <= 1")).arcs.select("src", F.col("ilabel").alias("label"), "weight", "dst")


SILENT = "(src + dst) % 2 = 0"


@query(f"""WITH RECURSIVE {N_SQL}, x AS (SELECT * FROM n WHERE {SILENT}), d(a, b, w) USING KEY (a, b) AS (
  SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT) FROM nation UNION
  SELECT d.a, x.dst, min(d.w + x.w) FROM d JOIN x ON x.src = d.b LEFT JOIN recurring.d r ON r.a = d.a AND r.b = x.dst WHERE r.w IS NULL OR d.w + x.w < r.w GROUP BY d.a, x.dst
) SELECT d.a AS src, n.dst + 1 AS label, CAST(min(d.w + n.w) AS DOUBLE) AS weight, n.dst FROM d JOIN n ON n.src = d.b AND NOT ({SILENT.replace('src', 'n.src').replace('dst', 'n.dst')}) GROUP BY ALL""")
def rm_epsilon_dist(spark, sf):
    label = F.when(F.expr(SILENT), F.lit(0)).otherwise(F.col("dst") + 1).cast("long")
    return reduce.rm_epsilon(nation_machine(spark, sf, label=label)).arcs.select("src", F.col("ilabel").alias("label"), "weight", "dst")


@query(f"""WITH RECURSIVE {N_SQL}, e AS (SELECT src, dst FROM n WHERE src < dst AND w % 3 = 0),
f AS (SELECT CAST(0 AS BIGINT) AS s UNION SELECT e.dst FROM f JOIN e ON e.src = f.s),
b AS (SELECT CAST(n_nationkey AS BIGINT) AS s FROM nation WHERE n_nationkey % 5 = 4 UNION SELECT e.src FROM b JOIN e ON e.dst = b.s),
k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS id FROM f WHERE s IN (SELECT s FROM b))
SELECT x.id AS src, y.s + 1 AS label, y.id AS dst FROM e JOIN k x ON x.s = e.src JOIN k y ON y.s = e.dst""")
def connect_trim(spark, sf):
    fst = nation_machine(spark, sf, final=F.when(F.col("state") % 5 == 4, F.lit(0.0)))
    fst = fst.with_(arcs=fst.arcs.filter("src < dst and weight % 3 = 0"))
    return reduce.connect(fst).arcs.select("src", F.col("ilabel").alias("label"), "dst")


# reduction


@query("SELECT p_name AS text, CAST(min(p_size) AS DOUBLE) AS weight FROM part GROUP BY 1")
def determinize_weights(spark, sf):
    """Each name with each of its sizes as a path of its own; the deterministic machine keeps the best."""
    w = parts(spark, sf).select("p_name", "p_size").distinct()
    w = w.withColumn("id", F.row_number().over(Window.orderBy("p_name", "p_size")))
    return words_of(reduce.determinize(strings.any_of_strings(w, "id", "p_name", "p_size").cut("names")))


@query("""WITH p AS (SELECT DISTINCT substr(p_name, 1, k) AS p FROM (SELECT DISTINCT p_name, unnest(range(0, length(p_name) + 1)) AS k FROM part))
SELECT 1 AS most, count(*) AS num_states, count(*) - 1 AS num_arcs FROM p""")
def determinize_is_dfa(spark, sf):
    """A state for each prefix, and one arc at most for each state and label."""
    d = reduce.determinize(some_words(spark, sf, "p_name"))
    most = d.arcs.groupBy("src", "ilabel").count().agg(F.max("count").alias("most"))
    return most.crossJoin(d.sizes().select("num_states", "num_arcs"))  # one row each


@query("""WITH w AS (SELECT DISTINCT p_name AS s FROM part), p AS (SELECT DISTINCT substr(s, 1, k) AS p FROM (SELECT s, unnest(range(0, length(s) + 1)) AS k FROM w)),
r AS (SELECT p, list(substr(s, length(p) + 1) ORDER BY s) AS rest FROM p JOIN w ON starts_with(s, p) GROUP BY p)
SELECT count(DISTINCT rest) AS num_states, (SELECT count(DISTINCT (rest, substr(x, 1, 1))) FROM (SELECT rest, unnest(rest) AS x FROM r) WHERE x <> '') AS num_arcs FROM r""")
def minimize_nerode(spark, sf):
    m = reduce.minimize(lexicon(parts(spark, sf), "p_name"))
    return m.sizes().select("num_states", "num_arcs")


@query("""WITH w AS (SELECT DISTINCT c_name AS s FROM customer), k AS (SELECT substr(s, 1, n) AS p, substr(s, n + 1) AS rest FROM (SELECT s, unnest(range(0, length(s) + 1)) AS n FROM w)),
r AS (SELECT p, list(rest ORDER BY rest) AS l FROM k GROUP BY p), h AS (SELECT p, md5(CAST(l AS VARCHAR)) AS c FROM r),
a AS (SELECT DISTINCT h.c, substr(rest, 1, 1) AS x FROM k JOIN h USING (p) WHERE rest <> '')
SELECT (SELECT count(DISTINCT c) FROM h) AS num_states, (SELECT count(*) FROM a) AS num_arcs""")
def minimize_customers(spark, sf):
    """A lexicon that grows with the table."""
    return reduce.minimize(lexicon(table(spark, sf, "customer"), "c_name")).sizes().select("num_states", "num_arcs")


@query("""SELECT r_name AS x, n_name AS y, CAST(min(n_nationkey) AS DOUBLE) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def optimize_transducer(spark, sf):
    """Region to nation, one path each, as a minimal machine of label pairs."""
    p = pairs(spark, sf).withColumn("w", F.col("n_nationkey").cast("double"))
    t = strings.compile_pairs(p, "n_nationkey", "r_name", "n_name")
    width = 1 + (t.states.agg(F.max("state")).first()[0] or 0)
    at = lambda c: (F.col("fst_id") * width + F.col(c) + 1).alias(c)
    zero = F.lit(0).cast("long")
    arcs = t.arcs.select(zero.alias("fst_id"), at("src"), "ilabel", "olabel", "weight", at("dst"))
    enter = t.meta.select(zero.alias("fst_id"), zero.alias("src"), zero.alias("ilabel"), zero.alias("olabel"), F.lit(0.0).alias("weight"), (F.col("fst_id") * width + 1).alias("dst"))
    ends = t.states.select(zero.alias("fst_id"), at("state"), F.when(F.col("final_weight").isNotNull(), F.col("fst_id").cast("double")).alias("final_weight"))
    states = ends.unionByName(spark.range(1).select(zero.alias("fst_id"), zero.alias("state"), F.lit(None).cast("double").alias("final_weight")))
    one = t.with_(meta=spark.range(1).select(zero.alias("fst_id"), zero.alias("start")), states=states, arcs=arcs.unionByName(enter)).cut("pairs")
    return reduce.optimize(one).language().select(label_text("ilabels").alias("x"), label_text("olabels").alias("y"), "weight")


@query(f"SELECT p_name AS text FROM part EXCEPT SELECT p_name FROM part WHERE p_size = 50")
def difference_lang(spark, sf):
    a = some_words(spark, sf, "p_name", "0")
    b = lexicon(parts(spark, sf).filter("p_size = 50"), "p_name")
    return words_of(difference(a, b)).select("text")


# replacement and rewriting


@query(f"SELECT DISTINCT x || ' ' || y AS text FROM (SELECT {FIRST} AS x FROM part), (SELECT {SECOND} AS y FROM part)")
def replace_grammar(spark, sf):
    """A phrase of nonterminals: NAME is ADJ, a space and NOUN, which are lexicons."""
    adj, noun, name = 1000, 1001, 1002
    root = frame(spark, 0, 0, {1: 0.0}, [(0, name, name, 0.0, 1)])
    phrase = frame(spark, 0, 0, {3: 0.0}, [(0, adj, adj, 0.0, 1), (1, 33, 33, 0.0, 2), (2, noun, noun, 0.0, 3)])
    lists = [lexicon(parts(spark, sf).select(F.expr(c).alias("w")), "w") for c in (FIRST, SECOND)]
    out = replace(root, [(name, phrase), (adj, lists[0]), (noun, lists[1])])
    return words_of(out).select("text")


@query("SELECT true AS refused")
def replace_cycle(spark, sf):
    one = frame(spark, 0, 0, {1: 0.0}, [(0, 1001, 1001, 0.0, 1)])
    two = frame(spark, 0, 0, {1: 0.0}, [(0, 1000, 1000, 0.0, 1)])
    try:
        replace(one, [(1000, one), (1001, two)])
        refused = False
    except CyclicDependency:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def cdrewrite_plain(spark, sf):
    rule = rewrite.Rule({"the": "THE"})
    return table(spark, sf, "documents").select("doc_id", rule.apply(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def cdrewrite_kernel(spark, sf):
    """The same rule by its machine: what rules that can't be lowered cost."""
    rule = rewrite.Rule({"the": "THE"})
    return table(spark, sf, "documents").select("doc_id", rule.kernel(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(c)a(n)', '\\1o\\2', 'g') AS text FROM documents")
def cdrewrite_context(spark, sf):
    rule = rewrite.Rule({"a": "o"}, ["c"], ["n"])
    return table(spark, sf, "documents").select("doc_id", rule.apply(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, translate(text, 'aeiou', 'AEIOU') AS text FROM conversations")
def cdrewrite_multi(spark, sf):
    rule = rewrite.Rule({c: c.upper() for c in "aeiou"})
    return table(spark, sf, "conversations").select("conv_id", "turn", rule.apply(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(text, '(s|n)t(e|i)', '\\1T\\2', 'g') AS text FROM conversations")
def cdrewrite_branching(spark, sf):
    """Contexts are sets; the patterns can't overlap, so the expression is their rule too."""
    rule = rewrite.Rule({"t": "T"}, ["s", "n"], ["e", "i"])
    return table(spark, sf, "conversations").select("conv_id", "turn", rule.kernel(F.col("text")).alias("text"))


@query("SELECT * FROM (VALUES ('abcd', 'ay'), ('abab', 'xx'), ('zabz', NULL), ('bcdbcd', 'yy'), ('dab', 'dx')) t(word, text)")
def cdrewrite_coverage(spark, sf):
    """Overlapping matches: the most symbols covered wins; a symbol outside sigma leaves no path."""
    rule = rewrite.Rule({"ab": "x", "bcd": "y"}, sigma=b"abcd")
    words = spark.createDataFrame([("abcd",), ("abab",), ("zabz",), ("bcdbcd",), ("dab",)], "word string")
    return words.select("word", rule.apply(F.col("word")).alias("text"))


# other semirings and predicates


@query("SELECT CAST(c_nationkey + 1 AS BIGINT) AS label, round(-ln(sum(exp(-(c_custkey % 13)))), 6) AS weight FROM customer GROUP BY 1")
def log_sum_paths(spark, sf):
    c = table(spark, sf, "customer").select(F.expr("c_nationkey + 1").alias("x"), F.expr("c_custkey % 13").alias("w"))
    fst = relation(c, "x", "x", "w").with_(semiring=Log)
    return fst.language().select(F.element_at("ilabels", 1).alias("label"), F.round("weight", 6).alias("weight"))


@query("""WITH e AS (SELECT c_custkey % 13 AS v, c_nationkey AS m FROM customer), f AS (SELECT s_suppkey % 11 AS w, s_nationkey AS m FROM supplier)
SELECT round(-ln(sum(exp(-(v + w)))), 6) AS weight, count(*) AS paths FROM e JOIN f USING (m)""")
def log_compose(spark, sf):
    """In the log semiring the composition filter decides values: every pair of paths counts once."""
    c = table(spark, sf, "customer").select(F.lit(1).alias("x"), F.expr("c_nationkey + 1").alias("y"), F.expr("c_custkey % 13").alias("w"))
    s = table(spark, sf, "supplier").select(F.expr("s_nationkey + 1").alias("y"), F.lit(1).alias("z"), F.expr("s_suppkey % 11").alias("w"))
    # a nation's customers and suppliers are parallel arcs: merged with their number, the product has an arc a nation, not one a pair
    out = compose(*(merge_parallel(m.with_(semiring=Log)) for m in (relation(c, "x", "y", "w"), relation(s, "y", "z", "w"))))
    return out.language().select(F.round("weight", 6).alias("weight"), "paths")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '[a-z]*e[a-z]* [a-z]*')")
def accept_filter(spark, sf):
    """An acceptor as a predicate: an e in the first word."""
    m = Machine()
    m.add_states(3)
    m.set_start(0)
    m.set_final(2)
    for x in spell("abcdefghijklmnopqrstuvwxyz"):
        for s in range(3):
            m.add_arc(s, x, x, 0.0, s)
    m.add_arc(0, *spell("e") * 2, 0.0, 1)
    m.add_arc(1, *spell(" ") * 2, 0.0, 2)
    return parts(spark, sf).filter(rewrite.accepts(F.col("p_name"), m)).select("p_partkey")


@query(f"WITH {N_SQL} SELECT src, dst + 1 AS ilabel, CAST(w AS DOUBLE) AS weight, dst FROM n WHERE src <> 5")
def delete_arcs(spark, sf):
    return nation_machine(spark, sf).delete_arcs(5).arcs.select("src", "ilabel", "weight", "dst")


@query("SELECT CAST(n_nationkey AS BIGINT) AS fst_id, lower(n_name) AS text FROM nation")
def print_products(spark, sf):
    """What a composition writes, read along the product's arcs, whatever its states' numbers."""
    low = Machine()
    low.set_start(low.add_state())
    low.set_final(0)
    for x in range(1, 257):
        b = x - 1
        low.add_arc(0, x, x + 32 if 65 <= b <= 90 else x, 0.0, 0)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return strings.print_strings(compose(strings.compile_strings(names, "id", "n_name"), low.frame(spark), shared=True))


@query("SELECT CAST(r_regionkey AS BIGINT) AS fst_id, r_name AS text FROM region")
def print_text_machines(spark, sf):
    """Chains whose states are numbered from the end, written as text, read again and printed."""
    r = strings.compile_strings(table(spark, sf, "region"), "r_regionkey", "r_name")
    n = r.chains
    turned = lambda df, *cs: df.join(n, "fst_id").select(*[(F.col("n") - F.col(c)).alias(c) if c in cs else F.col(c) for c in df.columns])
    back = r.with_(meta=turned(r.meta, "start"), states=turned(r.states, "state"), arcs=turned(r.arcs, "src", "dst"))
    return strings.print_strings(att.parse_lines(att.att_lines(back)))


@query(f"WITH {N_SQL} SELECT src, dst + 2 AS ilabel, CAST(w AS DOUBLE) AS weight, dst FROM n")
def convert_text(spark, sf):
    """N as a text file, converted to a binary file, which is read again."""
    top = f"{shared_dir(spark)}/weftline/convert-{uuid.uuid4().hex}"
    att.write_att(nation_machine(spark, sf), f"{top}/text")
    convert(spark, f"{top}/text/fst_id=0", f"{top}/binary", ["*.txt"], to="binary")
    return binary.read_binary(spark, f"{top}/binary", "*.fst")[0].arcs.select("src", "ilabel", "weight", "dst")


@query("SELECT conv_id, turn, replace(replace(text, 'th', 'z'), 'e', '') AS text FROM conversations")
def cdrewrite_delete(spark, sf):
    """A deletion beside another replacement: what it joins is no new match."""
    rule = rewrite.Rule({"e": "", "th": "z"})
    return table(spark, sf, "conversations").select("conv_id", "turn", rule.apply(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, replace(text, 'an', 'AN') AS text FROM conversations")
def rewrite_batch(spark, sf):
    """The rule of a stream on a table."""
    return rewrite_stream(table(spark, sf, "conversations").select("conv_id", "turn", "text"), rewrite.Rule({"an": "AN"}), "text")


@query("SELECT conv_id, turn, replace(text, 'the', 'THE') AS text FROM conversations")
def sql_rewrite(spark, sf):
    sql_functions.register_rule(spark, "weftline_shout", rewrite.Rule({"the": "THE"}))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr("weftline_shout(text)").alias("text"))


@query("SELECT p_name AS name, CAST(min(p_size) AS DOUBLE) AS weight FROM part GROUP BY 1")
def sql_paths(spark, sf):
    """Every path of a lexicon in binary form, by a table function."""
    sql_functions.register_paths(spark)
    data = binary.encode(some_words(spark, sf, "p_name"))
    return spark.sql("SELECT decode(p.istring, 'UTF-8') AS name, p.weight FROM {d} d, LATERAL fst_paths(d.data, NULL) p", d=data)


@query("SELECT c_nationkey, round(-ln(sum(exp(-(c_custkey % 13)))), 6) AS log, CAST(min(c_custkey % 13) AS DOUBLE) AS tropical FROM customer GROUP BY 1")
def sql_semiring_sum(spark, sf):
    sql_functions.register_semiring_sum(spark)
    c = table(spark, sf, "customer").select("c_nationkey", F.expr("CAST(c_custkey % 13 AS DOUBLE)").alias("w"))
    return spark.sql("SELECT c_nationkey, round(semiring_sum(w, 'log'), 6) AS log, semiring_sum(w, 'tropical') AS tropical FROM {c} GROUP BY c_nationkey", c=c)


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), x AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' ELSE 'x' END, '' ORDER BY ts, event_id) AS s, count(*) AS seen FROM e GROUP BY 1)
SELECT user_id, seen, regexp_full_match(s, '(vx|xv|vv|xx)*') AS accepted FROM x""")
def stream_follow(spark, sf):
    """A stream of events, each user followed by an acceptor of an even number of events."""
    m = Machine()
    m.add_states(2)
    m.set_start(0)
    m.set_final(0)
    for x in (1, 2):
        m.add_arc(0, x, x, 0.0, 1)
        m.add_arc(1, x, x, 0.0, 0)
    events = table(spark, sf, "events")
    told = f"{shared_dir(spark)}/weftline/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select("user_id", "event_id", F.when(F.col("event_type") == "view", 1).otherwise(2).cast("long").alias("label"))
    run = follow(stream, m, "user_id", "label", "event_id").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{told}/state")
    run.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{told}/out/batch={i}")).start().awaitTermination()
    # of a user's rows the one that has seen most is the last
    last = spark.read.parquet(f"{told}/out").groupBy("user_id").agg(F.max(F.struct("seen", "accepted")).alias("x"))
    return last.select("user_id", "x.seen", "x.accepted")
