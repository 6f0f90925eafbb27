"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ("link_drugs", "split_rank", "split_fnv", "greedy_match", "bio_tags", "lines_last_line", "validate_docs", "create_requests", "numeric_signature",
         "bio_examples", "plan_fold", "create_plans", "convert_label_studio", "convert_records", "field_outcomes", "sensitive_paths")


def rows(frame):
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    columns = sorted(frame.columns)
    return columns, sorted(repr([value(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "status", "drug_database_id", "confidence"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
