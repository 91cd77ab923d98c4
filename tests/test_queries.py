"""Every registered query against its SQL."""

import pytest

from ridgeline.plans import queries


def rows(columns, values):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in values)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = rows(columns, df.collect())
    if name not in queries.SQL:
        assert got
        return
    found = duck.sql(queries.SQL[name])
    assert sorted(found.columns) == columns
    want = rows(columns, [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()])
    assert got == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
