"""The tab-separated text format: arcs `src dst ilabel [olabel] [weight]`, finals `state [weight]`.

The first line's source is the start. A line of two fields is always a state with its weight; of four, the fourth is
an output label if it is a whole number, else a weight. label_shift is added to all labels but epsilon: 0 keeps raw
labels, 1 turns bytes into this package's labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import Fst, InvalidMachine
from weftline.plans.prefix import numbered
from weftline.semiring import INF, SEMIRINGS, weight_text
from weftline.sources.binary import file_ids


class InvalidFormat(InvalidMachine):
    pass


def parse_lines(lines: DataFrame, label_shift: int = 0, semiring: str = "tropical") -> Fst:
    """(fst_id, line_no, value) -> a batch; a malformed line is an error that names it."""
    x = lines.select("fst_id", "line_no", F.trim(F.regexp_replace("value", r"[ \t\r]+", " ")).alias("v")).filter("v <> ''")
    x = x.withColumn("t", F.split("v", " ")).withColumn("n", F.size("t"))
    whole = r"^\d{1,10}$"
    number = r"(?i)^([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity))$"
    at = lambda i: F.get("t", F.lit(i))
    four = at(3).rlike(whole)
    ok = F.when(F.col("n").isin(1, 2), at(0).rlike(whole) & ((F.col("n") == 1) | at(1).rlike(number)))
    ok = ok.when(F.col("n") == 3, at(0).rlike(whole) & at(1).rlike(whole) & at(2).rlike(whole))
    ok = ok.when(F.col("n") == 4, at(0).rlike(whole) & at(1).rlike(whole) & at(2).rlike(whole) & (four | at(3).rlike(number)))
    ok = ok.when(F.col("n") == 5, at(0).rlike(whole) & at(1).rlike(whole) & at(2).rlike(whole) & four & at(4).rlike(number))
    if bad := x.filter(~F.coalesce(ok, F.lit(False))).orderBy("fst_id", "line_no").take(1):
        raise InvalidFormat(f"machine {bad[0]['fst_id']}, line {bad[0]['line_no']}: {bad[0]['v']!r}")
    weight = lambda c: F.when(F.lower(c).rlike("inf"), F.lit(INF)).otherwise(c.cast("double"))
    long = lambda c: c.cast("long")
    label = lambda c: F.when(long(c) == 0, F.lit(0).cast("long")).otherwise(long(c) + label_shift)
    arcs = x.filter("n > 2")
    out = F.when(F.col("n") == 3, at(2)).when(F.col("n") == 5, at(3)).otherwise(F.when(four, at(3)).otherwise(at(2)))
    w = F.when(F.col("n") == 5, weight(at(4))).when((F.col("n") == 4) & ~four, weight(at(3))).otherwise(F.lit(0.0))
    arcs = arcs.select("fst_id", "line_no", long(at(0)).alias("src"), label(at(2)).alias("ilabel"), label(out).alias("olabel"), w.alias("weight"), long(at(1)).alias("dst"))
    finals = x.filter("n < 3").select("fst_id", "line_no", long(at(0)).alias("state"), F.when(F.col("n") == 2, weight(at(1))).otherwise(F.lit(0.0)).alias("w"))
    last = finals.groupBy("fst_id", "state").agg(F.max_by("w", "line_no").alias("w")).select("fst_id", "state", F.when(F.col("w") != INF, F.col("w")).alias("final_weight"))
    top = arcs.select("fst_id", F.greatest("src", "dst").alias("s")).unionByName(finals.select("fst_id", F.col("state").alias("s"))).groupBy("fst_id").agg(F.max("s").alias("top"))
    states = top.select("fst_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("state")).join(last, ["fst_id", "state"], "left")
    start = x.groupBy("fst_id").agg(F.min_by(long(at(0)), "line_no").alias("start"))
    return Fst(start, states, arcs.drop("line_no"), SEMIRINGS[semiring], "byte_plus_one" if label_shift else "raw")


def read_att(spark: SparkSession, path: str, glob: str | list[str] | None = None, label_shift: int = 0, semiring: str = "tropical") -> tuple[Fst, DataFrame]:
    """All files under path that fit a glob (or one of several), as one batch, and the table of their names (fst_id, file); ids go by name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="{" + ",".join(glob) + "}" if isinstance(glob, (list, tuple)) else glob).select(F.input_file_name().alias("file"), "value")
    names = file_ids(files)
    lines = files.join(names, "file").select("fst_id", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_lines(lines, label_shift, semiring), names.select("fst_id", "file")


def att_lines(fst: Fst) -> DataFrame:
    """fst_id, line_no, value: the start's arcs first, other states by id; then finals, the start first."""
    meta = fst.meta.select("fst_id", "start")
    arcs = fst.sorted_arcs().join(meta, "fst_id")
    w = F.when(F.col("weight") != 0, weight_text(F.col("weight")))
    arcs = arcs.select("fst_id", F.struct(F.lit(0).alias("part"), (F.col("src") != F.col("start")).alias("later"), F.col("src").alias("s"), F.col("ord").alias("o")).alias("k"), F.concat_ws("\t", "src", "dst", "ilabel", "olabel", w).alias("value"))
    w = F.when(F.col("final_weight") != 0, weight_text(F.col("final_weight")))
    finals = fst.states.filter("final_weight is not null").join(meta, "fst_id")
    finals = finals.select("fst_id", F.struct(F.lit(1).alias("part"), (F.col("state") != F.col("start")).alias("later"), F.col("state").alias("s"), F.lit(0).alias("o")).alias("k"), F.concat_ws("\t", "state", w).alias("value"))
    # numbered in cells of states, so that a large machine is not one window
    cell = (F.col("k.part") * 2 + F.when(F.col("k.later"), 1).otherwise(0)).cast("long") * 2**40 + F.shiftright(F.col("k.s"), 12)
    lines = arcs.unionByName(finals).withColumn("cell", cell)
    return numbered(lines, ["fst_id"], "cell", [F.col("k")], "line").select("fst_id", (F.col("line") + 1).alias("line_no"), "value")


def write_att(fst: Fst, path: str) -> None:
    """One folder `fst_id=...` of text for each machine."""
    lines = att_lines(fst)
    lines.repartition("fst_id").sortWithinPartitions("fst_id", "line_no").select("fst_id", "value").write.partitionBy("fst_id").text(path)

