"""The driver's contract: the flagship query and the agreement of small queries with their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text"] and df.count() == 200


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


#: Loops of many rounds, whose operators test_machines.py covers; the driver compares these queries too.
SLOW = {"compose_eps_filter", "difference_lang", "lazy_equals_eager", "lazy_sp_output", "optimize_transducer", "print_products"}


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_against_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = db.execute(catalogue.ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
