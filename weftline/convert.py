"""Converts a folder of machines in text form.

python -m weftline.convert --input DIR --output DIR [--glob G ...] [--to parquet|binary] [--suffix S] [--dry-run]

binary writes a file for each machine, called after its source with the last extension replaced by the suffix.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.sources import att, binary


def convert(spark: SparkSession, source: str, target: str, glob: str | list[str] | None = None, label_shift: int = 1, to: str = "parquet", dry_run: bool = False, suffix: str = ".fst") -> list[str]:
    """The files that match; unless dry_run, they are written as Parquet tables of one batch, or as a file of bytes each."""
    if dry_run:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(glob) + "}" if isinstance(glob, (list, tuple)) else glob or "*").load(source)
        return sorted(r["path"] for r in found.select("path").collect())
    fst, names = att.read_att(spark, source, glob, label_shift)
    if to == "binary":
        stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[^.]*$", "")
        binary.write_binary(fst, target, names.select("fst_id", stem.alias("name")), suffix)
    else:
        binary.write_parquet(fst, target)
        names.write.parquet(f"{target}/names")
    return [r["file"] for r in names.orderBy("fst_id").collect()]


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--glob", nargs="*")
    p.add_argument("--label-shift", type=int, choices=(0, 1), default=1)
    p.add_argument("--to", choices=("parquet", "binary"), default="parquet")
    p.add_argument("--suffix", default=".fst")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args()
    for f in convert(SparkSession.builder.getOrCreate(), a.input, a.output, a.glob, a.label_shift, a.to, a.dry_run, a.suffix):
        print(f)


if __name__ == "__main__":
    main()
