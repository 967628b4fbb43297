"""The dealt queries: registered, with SQL where SQL can say it, over the whole tables."""

import re
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from compare import rows_of, rows_of_sql

import __spark_entry__ as entry
from chronoweave.llm.queries import ORACLE_SQL, QUERIES


def test_all_ten_and_the_pipeline_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_a_row_for_each_of_its_table(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir)
    table, key = ("pages", "page_id") if name.startswith("op1_") else ("conversations", "conv_id") if name.startswith("op3_") else ("documents", "doc_id")
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()
