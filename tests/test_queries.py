"""Every query with SQL against DuckDB, and the contract of the registry."""

import pytest

import __spark_entry__ as e
from tests.oracle import differences
from tidemark import queries_chunks, queries_data, queries_dictionary, queries_findings, queries_quality, queries_records, queries_series

OWN = queries_series.QUERIES | queries_quality.QUERIES | queries_data.QUERIES | queries_chunks.QUERIES | queries_dictionary.QUERIES | queries_findings.QUERIES | queries_records.QUERIES
SQL = queries_series.ORACLE | queries_quality.ORACLE | queries_data.ORACLE | queries_chunks.ORACLE | queries_dictionary.ORACLE | queries_findings.ORACLE | queries_records.ORACLE


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    assert differences(OWN[name](spark, sf_dir), SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert OWN[name](spark, sf_dir).count() > 0


def test_entry(spark):
    got = e.entry(spark)
    assert got.count() > 0 and "rule" in got.columns
    assert set(e.oracle_sql()) <= set(e.queries())
