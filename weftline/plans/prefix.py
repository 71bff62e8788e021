"""Distributed prefix sums: totals of buckets first, running sums inside each bucket after.

A global running sum needs no single sorted partition: rows get a bucket whose order agrees with the order of the
rows, the buckets' totals (one row each) are summed, and each bucket runs its own window. Every function here uses
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import shuffle_partitions

TIES = 4096  # parts of a range that is one key


def bucket_count(df: DataFrame) -> int:
    """Buckets grow with the session's shuffle partitions, which are set by the size of the data."""
    return max(64, 2 * shuffle_partitions(df.sparkSession))


def hash_bucket(df: DataFrame, hexes: Column) -> Column:
    """One of bucket_count() equal ranges of hexadecimal hashes."""
    return F.shiftright(F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long") * F.lit(bucket_count(df)), 32)


def _constant(values: list[int]) -> Column:
    """An array literal of any length, as one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Ranges:
    """Ranges of a whole-number key: range 0 ends before starts[0], range i begins at starts[i - 1]; hot ones are one key each."""

    starts: tuple[int, ...]
    hot: tuple[bool, ...]

    def position(self, key: Column) -> Column:
        """A key's range by binary search, -1 for null."""
        if not self.starts:
            return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
        table, n = _constant(list(self.starts)), len(self.starts)
        powers = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(n.bit_length()))])
        step = lambda at, p: F.when((at + p <= n) & (F.get(table, (at + p - 1).cast("int")) <= key), at + p).otherwise(at)
        return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(F.aggregate(powers, F.lit(0).cast("long"), step))

    def bucket(self, key: Column, tie: Column) -> Column:
        """A number that agrees with the order of (key, tie), nulls first. tie, 0 to TIES - 1, parts null and hot keys."""
        at = self.position(key)
        parts = (at < 0) if not any(self.hot) else (at < 0) | (F.get(_constant([int(x) for x in self.hot]), at.cast("int")) == 1)
        return (at + 1) * TIES + F.when(parts, tie.cast("long")).otherwise(F.lit(0).cast("long"))


def ranges(df: DataFrame, key: str, n: int, weight: str | None = None) -> Ranges:
    """About n ranges with equal sums of weight (of rows without it), from approximate quantiles of the key.

    A key that holds more than a range's share becomes a range of its own. The driver gets n numbers.
    """
    rows = df.select(F.col(key).cast("long").alias("k"))
    if weight:
        mean = df.agg(F.avg(weight)).first()[0] or 1
        rows = df.select(F.col(key).cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.floor(F.col(weight) / F.lit(float(mean) or 1.0)).cast("int"))))
    found = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 5 * n).alias("b")).first()["b"] if n > 1 else None
    found = found or []
    alone = {x for x, y in zip(found, found[1:], strict=False) if x == y}
    starts = sorted(set(found) | {x + 1 for x in alone if x < 2**63 - 1})
    return Ranges(tuple(starts), (False, *(x in alone for x in starts)))


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, before: str, index: str) -> DataFrame:
    """Adds, per group, the sum of value before each row and the row's index from 0, in the order of bucket and order.

    group and bucket hold no nulls. df is read twice, so it should be a table that is written already. A group may
    hold any share of the rows: work is split by bucket, and only totals of buckets meet in one window.
    """
    keys = [*group, bucket]
    over = Window.partitionBy(*group) if group else Window.partitionBy()
    over = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    totals = totals.select(*keys, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__sum_at"), F.coalesce(F.sum("__rows").over(over), F.lit(0)).alias("__row_at"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__run", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).withColumn("__row", F.row_number().over(inside) - 1)
    out = out.join(totals, keys)
    return out.withColumn(before, (F.col("__run") + F.col("__sum_at")).cast("long")).withColumn(index, (F.col("__row") + F.col("__row_at")).cast("long")).drop("__run", "__row", "__sum_at", "__row_at")


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], index: str) -> DataFrame:
    """Adds each row's index from 0 in its group, in the order of bucket and order."""
    return running(df.withColumn("__one", F.lit(1)), group, bucket, order, "__one", "__before", index).drop("__one", "__before")
