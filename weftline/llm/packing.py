"""Length buckets with the least padding, and batches of a token budget inside each bucket.

The histogram of all lengths (one row for each length that occurs) goes to a dynamic program: with k buckets, the
cheapest way to cover the j shortest lengths ends in a bucket whose rows are all padded to length j. The padding of a
bucket satisfies the quadrangle inequality, so the best place of the last cut rises with j, and divide and conquer
finds the optimum in k * L * log(L) steps. Ties go to the smaller cut. Documents are numbered inside their bucket in
the order of a seeded hash; as many as fit into the budget when padded make a batch.

The driver holds the histogram, whose size is the number of different lengths: at most that of the longest text. Eight
buckets over 100 000 different lengths take it 4 seconds, over a million 36 seconds (measured on one core).

Defined results: a null text has no tokens, a long one counts as a whole; a bucket longer than the budget has batches of one; with fewer lengths
than buckets there is a bucket for each; repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.mixing import seeded, word_count
from weftline.plans.prefix import hash_bucket, running
from weftline.session import materialise


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The longest length of each bucket, for the least padding; lengths ascend."""
    size = len(lengths)
    if not size:
        return []
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(lengths * counts)]
    cost = np.r_[0, lengths * rows[1:] - tokens[1:]].astype(np.int64)  # with one bucket
    cuts = []
    for k in range(2, min(n_buckets, size) + 1):
        now, cut = np.full(size + 1, np.iinfo(np.int64).max // 2), np.zeros(size + 1, np.int64)
        todo = [(k, size, k - 1, size - 1)]
        while todo:
            lo, hi, from_, to = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(from_, min(to, j - 1) + 1)
            total = cost[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            best = int(np.argmin(total))
            now[j], cut[j] = total[best], i[best]
            todo += [(lo, j - 1, from_, int(i[best])), (j + 1, hi, int(i[best]), to)]
        cost = now
        cuts.append(cut)
    ends, j = [size], size
    for cut in reversed(cuts):
        j = int(cut[j])
        ends.append(j)
    return [int(lengths[e - 1]) for e in reversed(ends)]


def pack(docs: DataFrame, n_buckets: int = 8, token_budget: int = 16384, seed: str = "pack-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, bucket (from 0, short to long), bucket_len, batch (of its bucket), slot (in its batch) and padding."""
    slim = materialise(docs.select(F.col(id_col).alias("__id"), word_count(F.col(text_col)).alias("n_tokens"), seeded(id_col, text_col, seed).alias("__hash")), "pack-sizes")
    histogram = sorted((r["n_tokens"], r["count"]) for r in slim.groupBy("n_tokens").count().collect())
    ends = bucket_lengths(np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), n_buckets) or [0]
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("n_tokens")))
    slim = slim.withColumn("bucket", bucket).withColumn("__part", hash_bucket(slim, F.col("__hash")))
    placed = running(slim, ["bucket"], "__part", [F.col("__hash"), F.col("n_tokens")], "n_tokens", "__before", "__index")
    length = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    placed = placed.withColumn("bucket_len", length).withColumn("__rows", F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))))
    return placed.select(F.col("__id").alias(id_col), "n_tokens", "bucket", "bucket_len", F.floor(F.col("__index") / F.col("__rows")).cast("long").alias("batch"), F.pmod("__index", "__rows").cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
