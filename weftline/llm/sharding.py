"""Contiguous shards of near-equal bytes, cut from a global prefix sum of sizes (DataFrame operations only).

Rows are put in ascending order of the id (ties: checksum, size). Ranges of ids are the partitions whose totals are
summed first; each row's place in the whole is its range's offset plus its running sum inside the range. A row
belongs to the shard whose equal target holds the middle of its bytes, so each cut is off by half a row at most.

An id that many rows share, null too, is parted by checksum.

Defined results: a null text counts as empty and has size 1, a long text counts as a whole; null ids come first; rows that are equal in id and
text follow each other in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.prefix import bucket_count, ranges, running
from weftline.session import materialise


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in each shard) and byte_offset of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = materialise(slim, "shard-sizes")
    found = ranges(slim, id_col, bucket_count(slim))
    slim = slim.withColumn("__range", found.bucket(F.col(id_col), F.shiftright("text_crc32", 20)))
    total = slim.agg(F.sum("size")).first()[0] or 1
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = running(slim, [], "__range", order, "size", "byte_offset", "__index")
    # middle of the row's bytes * shards / total, in whole numbers
    middle = F.expr(f"((2 * byte_offset + size) * {n_shards}L) div (2 * {total}L)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    starts = placed.groupBy("shard").agg(F.min("__index").alias("__start"))
    placed = placed.join(F.broadcast(starts), "shard")  # one row a shard
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("__index") - F.col("__start")).cast("long").alias("slot"), "byte_offset")
