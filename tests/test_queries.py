"""Every registered query against its SQL on the small tables, and the entry points."""

import glob
import os

import duckdb
import pytest

from reportlake import plans


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, sf, oracle, name):
    frame = plans.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = oracle.execute(plans.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(same(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_stream_equals_batch(spark, sf):
    key = lambda f: sorted(map(tuple, f.select("scope", "output_chars", "accepted", "refused").collect()))
    assert key(plans.QUERIES["budget_stream"](spark, sf)) == key(plans.QUERIES["budget_fold"](spark, sf))


def test_extraction_reads_all_lines(spark, sf):
    rows = {r.doc_id: r for r in plans.QUERIES["ocr_batches"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [x for x in d.text.split("\n") if x.strip()]
        assert rows[d.doc_id].error is None and rows[d.doc_id].pages == len(lines)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "report_ref", "chunk_id", "page", "heading", "score", "snippet"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
