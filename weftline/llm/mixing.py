"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Every source wants its weight's share of the budget and may be read max_epochs times. Sources above that cap are
clamped, and what they leave is reshared among the others in proportion to weight, until no source is above its cap.
A source's target then becomes whole repetitions of all its documents plus a seeded sample for the fraction: its
documents in the order of a seeded hash, taken until the fraction's words are reached. The last document of the
sample gives its first words only, so the words taken equal the target, rounded down, and no document is taken
more than ceil(target / source size) times.

Defined results: null or empty texts have size 0 and take nothing, long texts count as a whole; the null source is a source
of its own and comes last; repeated rows are documents of their own, as are rows that share an id (or have none); an empty table gives no rows; other columns are kept by mixed_rows()
and ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.prefix import bucket_count, hash_bucket, numbered, running
from weftline.session import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(id_col: str, text_col: str, seed: str) -> Column:
    """The hash that puts rows in order: of id, seed and text, so that rows that share an id are spread like others."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(text(id_col), F.lit(f"|{seed}|"), text(text_col)).cast("binary"))


def water_level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight for sources below their cap. sources: weight, cap.

    Each round is one distributed aggregation with one row of result; the level only rises, and it stops when a
    round clamps no further source.
    """
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("n")).first()
        if not r["free"]:
            return level
        level = max(level, (budget - float(r["held"] or 0)) / float(r["free"]))
        if r["n"] == clamped:
            return level
        clamped = r["n"]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size, source_size, target (of its source), whole (repetitions), part (words of one more), taken, row_hash.

    weights go round the sources in code point order. The budget is share of all words.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    slim = docs.select(F.col(id_col).alias("__id"), key.alias("__source"), word_count(F.col(text_col)).alias("size"), seeded(id_col, text_col, seed).alias("__hash"))
    slim = materialise(slim.withColumn("__bucket", hash_bucket(slim, F.col("__hash"))), "mix-sizes")
    sources = slim.groupBy("__source").agg(F.sum("size").alias("source_size"))
    # sources are numbered in ranges of names, of which there may be many
    sources = materialise(sources.repartitionByRange(max(2, bucket_count(sources) // 32), "__source").withColumn("__range", F.spark_partition_id()), "mix-ranges")
    turn = F.pmod(F.col("__turn"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sources = numbered(sources, [], "__range", [F.col("__source")], "__turn")
    sources = materialise(sources.select("__source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole)
    sources = sources.withColumn("__more", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).drop("weight", "cap")
    placed = running(slim, ["__source"], "__bucket", [F.col("__hash"), F.col("size")], "size", "__before", "__index")
    # the few columns of a source ride on its buckets' totals' key; Spark broadcasts them if they are small, else splits skewed sources
    placed = placed.join(sources, "__source")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__more") - F.col("__before"))).cast("long")
    source = F.when(F.col("__source") == "1", F.lit(None)).otherwise(F.expr("substring(__source, 2)"))
    return placed.select(F.col("__id").alias(id_col), source.alias(source_col), "size", F.col("source_size").cast("long"), "target", "whole", part.alias("part"), (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), F.col("__hash").alias("row_hash"))


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """The mix itself: docs' columns, a row for each repetition; a repetition in part has the document's first words.

    mixed is what mix() gives for docs and the same seed. Documents without words add nothing and are left out. Rows
    that are equal in id, text and source take the same, but for those of one group a source at most, in which the
    sample ends: these are numbered.
    """
    names = docs.columns
    key = ["__hash", "__source"]
    keyed = docs.withColumn("__hash", seeded(id_col, text_col, seed)).withColumn("__source", F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")))
    plan = mixed.filter("size > 0").select(F.col("row_hash").alias("__hash"), F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("__source"), "whole", "part", "size")
    plan = plan.groupBy(*key).agg(F.max("whole").alias("__whole"), F.max("size").alias("__size"), F.min("part").alias("__least"), F.max("part").alias("__most"), F.count(F.when(F.col("part") == F.col("size"), 1)).alias("__full"), F.max(F.when(F.col("part") < F.col("size"), F.col("part"))).alias("__rest"))
    plan = materialise(plan.filter("__whole > 0 or __most > 0"), "mix-plan")
    even = keyed.join(plan.filter("__least = __most"), key).withColumn("__part", F.col("__most"))
    ends = materialise(plan.filter("__least < __most"), "mix-ends")  # a row a source at most, so texts need no shuffle here
    split = materialise(keyed.join(ends, key).withColumn("__range", F.spark_partition_id()), "mix-split")
    split = numbered(split, key, "__range", [F.col("__hash")], "__at")
    split = split.withColumn("__part", F.when(F.col("__at") < F.col("__full"), F.col("__size")).when(F.col("__at") == F.col("__full"), F.coalesce("__rest", F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("__at", "__range")
    out = even.unionByName(split.select(*even.columns))
    # a part that is all of the document is a whole repetition
    out = out.withColumn("__whole", F.col("__whole") + F.when(F.col("__part") >= F.col("__size"), 1).otherwise(0))
    out = out.withColumn("__part", F.when(F.col("__part") < F.col("__size"), F.col("__part")).otherwise(0))
    out = out.withColumn("__copy", F.explode(F.expr("sequence(if(__whole > 0, 1, 0), if(__part > 0, __whole + 1, __whole))"))).filter("__copy > 0 and (__copy <= __whole or __part > 0)")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("__part").cast("int")), "")
    cut = F.col("__copy") > F.col("__whole")
    out = out.withColumn(text_col, F.when(cut, head).otherwise(F.col(text_col)))
    if "n_chars" in names and text_col != "n_chars":
        out = out.withColumn("n_chars", F.when(cut, F.length(text_col)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)
