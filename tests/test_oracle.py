"""Every query with oracle SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import math

import pytest

from walletlens.plans import registry

DUCK_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(comparable(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_and_types(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    theirs_columns = [column[0] for column in result.description]
    theirs_types = {column[0]: str(column[1]) for column in result.description}
    assert {column: DUCK_TYPES[kind] for column, kind in ours.dtypes} == theirs_types
    got = rows_of(ours.columns, ours.collect())
    expected = rows_of(theirs_columns, result.fetchall())
    assert len(expected) > 0
    assert len(got) == len(expected)
    different = [(g, e) for g, e in zip(got, expected) if g != e]
    assert not different, f"{len(different)} of {len(got)}: {different[:3]}"

