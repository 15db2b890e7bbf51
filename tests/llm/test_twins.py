"""Queries against their SQL twins: on the smallest tables, and on rows that the tables lack."""

import os
import sys

import pytest

from regionpulse.llm.queries import REGISTRY, SQL
from tests.conftest import SF0001
from tests.llm.test_native import TRICKY, disclosure_fixture

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))


def same(spark, name, folder):
    import duckdb
    import oracle_compare as oc

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'/*.parquet' if os.path.isdir(f'{folder}/documents.parquet') else ''}')")
    spark_rows, sql_rows = oc.digest(REGISTRY[name](spark, folder).toPandas()), oc.digest(con.sql(SQL[name]).df())
    assert spark_rows[:3] == sql_rows[:3], (sorted(set(spark_rows[3]) - set(sql_rows[3]))[:2], sorted(set(sql_rows[3]) - set(spark_rows[3]))[:2])


@pytest.mark.parametrize("name", sorted(SQL))
def test_smallest_tables(spark, name):
    same(spark, name, SF0001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_planted_rows(spark, docs, tmp_path, name):
    plain = [f"line one\nline one\n{'some words of text ' * 6}{k}" for k in range(12)]
    texts = [None, "", " \n ", "one", *plain, *disclosure_fixture(), *TRICKY[:7], "Released under the MIT License."]
    sources = [["a", "b", None][k % 3] for k in range(len(texts))]
    docs(texts, sources).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, name, str(tmp_path))
