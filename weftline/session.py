"""Session helpers: one place for the shared folder and the shipped-by-value rule for worker code."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value(module: str) -> None:
    """Have a module's functions pickled with their code, so workers need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, shared by all executors; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet under the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_weftline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs that run inside send so many rows at once to Python: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def text_batches(spark: SparkSession, n: int = 1000, n_bytes: int = 8 << 20) -> None:
    """From now on the session sends at most so many rows and bytes at once to Python: whole texts are large rows.

    A row beyond n_bytes is a batch of its own. The setting stays, as the frames that operators return run later; smaller
    settings of the session are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", n), ("spark.sql.execution.arrow.maxBytesPerBatch", n_bytes)):
        have = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))  # a size in other units is the caller's choice
        if have and not 0 < int(have[1]) <= most:
            spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SMALL = 100_000  # rows; a few MB of a loop's table


def hold(df: DataFrame, tag: str, like: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of a loop's table: up to SMALL rows are held by the driver as a local relation, more are written.

    The rows are the same either way. Where `like` (the round before) had to be written, so is this one, without trying first.
    """
    if getattr(like, "_weftline_path", None):
        return materialise(df, tag)
    rows = df.limit(SMALL + 1).toArrow()
    if rows.num_rows > SMALL:
        return materialise(df, tag)
    # in one partition, so that rounds over small tables need no shuffle
    out = df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)
    out._weftline_rows = rows.num_rows
    return out


def row_count(df: DataFrame) -> int:
    known = getattr(df, "_weftline_rows", None)
    return df.count() if known is None else known
