"""The corpus pipeline against a plain version of its stages, and the registered queries' shapes."""

import re

import pytest

import corpus_pipeline
from tests.llm import brute
from weftline.llm import queries

SF = "/root/testdata/sf0.001"
WORD_AND_SPACE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == names and out.count() >= 0.98 * docs.count()
    rows = [r.asDict() for r in out.collect()]
    kept = {i for i, _, c in brute.near_duplicates(rows, 5) if i == c}
    rows = [r for r in rows if r["doc_id"] in kept]
    for r, m in zip(rows, brute.repeated(rows), strict=True):
        r["text"] = bytes(x for x, y in zip(r["text"].encode(), m, strict=True) if not y).decode("utf-8", "ignore")
    rows = [r for r in rows if brute.words(r["text"])]
    mixed = []
    for r, (_, size, _, _, taken) in zip(rows, brute.mix(rows), strict=True):
        whole, part = divmod(taken, size)
        mixed += [r] * whole
        if part:
            mixed.append(dict(r, text="".join(WORD_AND_SPACE.findall(r["text"])[:part])))
    want = brute.pack(mixed)
    got = [(r["doc_id"], r["n_tokens"], r["bucket"], r["bucket_len"], r["batch"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "the same words in every row " * 3, "en", "s", 81)] * 4 + [(None, "the same words in every row " * 3, None, None, None), (2, "", "en", "s", 0), (2, None, "en", None, None)]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """Empty tables, nulls in any column, repeated rows, other columns with clashing names: no stage fails, and columns stay."""
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as bucket", "'y' as node", "3 as row_hash", "4 as source_size", "5 as spans")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == sizes[-1]
    if rows and rows[0][0] == 1:
        assert {r["doc_id"] for r in docs.collect()} == {1}  # one row of the copies stays, twice as often as its source may be read
    if not rows:
        assert sizes == [0] * 4


def test_pipeline_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, None, None, None)], SCHEMA)
    assert corpus_pipeline.language(spark, docs, SF).count() == 2


@pytest.mark.parametrize(("stage", "function"), [("language", "classify("), ("repeated_passages", "_kept_text(")])
def test_filters_stay_above_functions(spark, stage, function):
    """A filter on a function's result must not be pushed below it, or the function runs twice on each text."""
    out = dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line and function in line for line in plan.splitlines()) == 1
