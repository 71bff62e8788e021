"""Machines as bytes: one binary column or file for each, and Parquet tables for whole batches."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.machine import Machine
from weftline.model import Fst
from weftline.plans.packed import ARC_FIELDS, InvalidFormat, Packed, freeze, thaw
from weftline.semiring import SEMIRINGS
from weftline.session import materialise, ship_by_value, text_batches

ship_by_value(__name__)

ROWS = "fst_id long, start int, finals array<double>, offsets array<int>, arcs array<struct<ilabel:long,olabel:long,weight:double,dst:int>>"


def encode(fst: Fst) -> DataFrame:
    """fst_id, data: the binary form of each machine."""
    code = fst.semiring.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            finals, offsets, arcs = (b.column(c) for c in ("finals", "offsets", "arcs"))
            out = []
            for k, start in enumerate(b.column("start").to_pylist()):
                row = arcs[k].values
                columns = {c: row.field(c).to_numpy(zero_copy_only=False) for c in ARC_FIELDS}
                ends = [x[k].values.to_numpy(zero_copy_only=False) for x in (finals, offsets)]
                out.append(Packed.of_row(start, *ends, columns, code).to_bytes())
            yield pa.record_batch([b.column("fst_id"), pa.array(out, pa.binary())], ["fst_id", "data"])

    text_batches(fst.spark)  # a machine is a large row
    return freeze(fst).mapInArrow(run, "fst_id long, data binary")


def decode(data: DataFrame, semiring: str = "tropical", encoding: str = "byte_plus_one") -> Fst:
    """(fst_id, data) -> a batch; unsound bytes are an error."""
    arc = pa.struct([("ilabel", pa.int64()), ("olabel", pa.int64()), ("weight", pa.float64()), ("dst", pa.int32())])
    schema = pa.schema([("fst_id", pa.int64()), ("start", pa.int32()), ("finals", pa.list_(pa.float64())), ("offsets", pa.list_(pa.int32())), ("arcs", pa.list_(arc))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                p = Packed.from_bytes(r["data"])
                n = [int(x) for x in p.states["n"]]
                arcs = [{"ilabel": int(a["ilabel"]), "olabel": int(a["olabel"]), "weight": float(a["weight"]), "dst": int(a["dst"])} for s in range(len(n)) for a in p.arcs_of(s)]
                out.append({"fst_id": r["fst_id"], "start": p.start, "finals": [float(x) for x in p.states["final"]], "offsets": [0, *accumulate(n)], "arcs": arcs})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    text_batches(data.sparkSession)
    rows = data.select("fst_id", "data").mapInArrow(run, ROWS)
    like = Fst(rows.select("fst_id"), rows, rows, SEMIRINGS[semiring], encoding)
    return thaw(rows, like)


def read_binary(spark: SparkSession, path: str, glob: str = "*", semiring: str = "tropical", encoding: str = "byte_plus_one") -> tuple[Fst, DataFrame]:
    """All files under path as one batch, and their names (fst_id, file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), F.col("content").alias("data"))
    names = file_ids(files)
    return decode(files.join(names, "file"), semiring, encoding), names.select("fst_id", "file")


def file_ids(files: DataFrame) -> DataFrame:
    """file, fst_id: ids from 0 by name. Spark's own list of the files is on the driver already, so one task may sort it."""
    return files.select("file").distinct().withColumn("fst_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))


def write_binary(fst: Fst, path: str, names: DataFrame | None = None, suffix: str = ".fst") -> DataFrame:
    """A file for each machine in the folder path, which all executors reach; file, fst_id, bytes of what was written.

    names (fst_id, name) says what files are called; else it's the id. A file is written under another name first and
    then renamed, so a task that is run again or twice leaves one whole file.
    """
    rows = encode(fst)
    rows = rows.withColumn("name", F.col("fst_id").cast("string")) if names is None else rows.join(names.select("fst_id", "name"), "fst_id")
    schema = pa.schema([("file", pa.string()), ("fst_id", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(top, recursive=True)
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = f"{top}/{r['name']}{suffix}"
                part = f"{top}/_{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(r["data"])
                store.move(part, name)
                out.append({"file": name, "fst_id": r["fst_id"], "bytes": len(r["data"])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    done = rows.select("fst_id", "name", "data").mapInArrow(run, "file string, fst_id long, bytes long")
    return materialise(done, "files")  # the action that writes them


# fixed values: the public binary form of vector machines that other toolkits write, little-endian
VECTOR_MAGIC, SYMBOLS_MAGIC = 2125659606, 2125658996


def parse_vector(data: bytes) -> Machine:
    """A machine from the public vector form (standard or log arcs with 32-bit weights); its labels are kept as they are."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        if at + struct.calcsize(form) > len(data):
            raise InvalidFormat("the file ends too early")
        found = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return found

    def text() -> str:
        nonlocal at
        (n,) = take("<i")
        if not 0 <= n <= len(data) - at:
            raise InvalidFormat("a string's length is out of range")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    if take("<i")[0] != VECTOR_MAGIC:
        raise InvalidFormat("not a binary machine")
    kind, arc = text(), text()
    _, flags, _, start, n, _ = take("<iiQqqq")
    if kind != "vector" or arc not in ("standard", "log") or n < 0:
        raise InvalidFormat(f"{kind} machines of {arc} arcs aren't read, vector machines of standard or log arcs are")
    for bit in (1, 2):  # symbol tables that are part of the file
        if flags & bit:
            if take("<i")[0] != SYMBOLS_MAGIC:
                raise InvalidFormat("a symbol table is announced and isn't there")
            text()
            for _ in range(take("<qq")[1]):
                text()
                take("<q")
    out = Machine()
    out.add_states(n)
    for s in range(n):
        (final,) = take("<f")
        out.set_final(s, final)
        for _ in range(take("<q")[0]):
            i, o, w, d = take("<iifi")
            if i < 0 or o < 0 or not 0 <= d < n:
                raise InvalidFormat("a label or target out of range")
            out.arcs[s].append((i, o, w, d))
    if start >= 0:
        out.set_start(start)
    return out


def read_vector(spark: SparkSession, path: str, glob: str = "*", label_shift: int = 1) -> tuple[Fst, DataFrame]:
    """All vector machines under path as one batch, and their names; label_shift as for text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = parse_vector(r["data"])
                up = lambda x: x + label_shift if x else 0
                m.arcs = [[(up(i), up(o), w, d) for i, o, w, d in a] for a in m.arcs]
                out.append({"fst_id": r["fst_id"], "data": Packed.of(m).to_bytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("fst_id", pa.int64()), ("data", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), F.col("content").alias("data"))
    names = file_ids(files)
    data = files.join(names, "file").select("fst_id", "data").mapInArrow(run, "fst_id long, data binary")
    return decode(data, "tropical", "byte_plus_one" if label_shift else "raw"), names.select("fst_id", "file")


def write_parquet(fst: Fst, path: str) -> None:
    for name in ("meta", "states", "arcs"):
        getattr(fst, name).write.parquet(f"{path}/{name}")


def read_parquet(spark: SparkSession, path: str, semiring: str = "tropical", encoding: str = "byte_plus_one") -> Fst:
    return Fst(*(spark.read.parquet(f"{path}/{name}") for name in ("meta", "states", "arcs")), SEMIRINGS[semiring], encoding)
