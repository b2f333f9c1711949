"""Every query runs and has its columns."""

import glob
import os

import duckdb
import pytest

from weftlens.llm import catalogue

FOUND = {
    "p1_found": [("src_table", "string"), ("row_id", "bigint"), ("seg_no", "int"), ("lang", "string")],
    "p2_found": [("src_table", "string"), ("first_row", "bigint"), ("copy_row", "bigint")],
    "p5_found": [("flag_id", "bigint"), ("option_id", "bigint")],
    "p3_found": [("src_table", "string"), ("row_a", "bigint"), ("row_b", "bigint")],
    "p4_found": [("src_table", "string"), ("row_id", "bigint"), ("category", "string")],
    "p6_found": [("src_table", "string"), ("row_id", "bigint"), ("pii_type", "string")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("reading_level", "int")],
}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert name not in FOUND or df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    result = con.execute(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, sf_dir).select([d[0] for d in result.description])
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
