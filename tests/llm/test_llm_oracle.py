"""Every query of the package with oracle SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import pytest

from walletlens.llm import queries

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(ours.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in ours.collect())
    assert got == sorted(repr(tuple(row)) for row in result.fetchall())
    assert got
