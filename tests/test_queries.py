"""Every registered query against the same thing in DuckDB, and the shape of those without."""

import pytest
import stated
from helpers import DATA, duck_rows, spark_rows

from fernmill.plans import connected, queries, rules, serving

QUERIES, SQL = queries.QUERIES | connected.QUERIES | rules.QUERIES | serving.QUERIES, queries.SQL | connected.SQL | rules.SQL | serving.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    assert spark_rows(QUERIES[name](spark, str(DATA))) == duck_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_module_without_the_libraries_of_the_subpackage():
    """A library that only the training-data part needs may be missing: the other queries still import."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tiktoken'] = None; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'group_rank' in e.queries() and 'op9_toxicity' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("name", sorted(stated.SQL))
def test_stated_values(spark, name):
    """Rules on inline values, beside the results stated for them."""
    assert spark_rows(stated.QUERIES[name](spark, str(DATA))) == duck_rows(stated.SQL[name])
