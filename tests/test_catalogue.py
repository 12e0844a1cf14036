"""Every registered query against its SQL on DuckDB, over the smallest given tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, data, connection, name):
    equal, message = compare(QUERIES[name](spark, data), connection, CHECKS[name])
    assert equal, message


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["ols_p", "logit_zp", "forest_importance"])
def test_results_without_sql(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows
    for row in rows:
        for column in ("p_value", "importance"):
            if column in row and row[column] is not None:
                assert 0 <= row[column] <= 1


def test_model_compare_beats_guessing(spark, data):
    rows = QUERIES["model_compare"](spark, data).collect()
    assert len(rows) == 20
    assert all(0.4 < row["accuracy"] <= 1 for row in rows)
    assert sum(row["accuracy"] > 0.6 for row in rows) >= 15
