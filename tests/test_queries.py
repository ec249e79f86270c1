"""Each query of the library against its oracle, and the shape of the registry."""

import pytest

from lectern.plans import registry


def _rows(names, rows):
    cut = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cut(r[c]) for c in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_oracle(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.sql(registry.ORACLES[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert _rows(names, got) == _rows(names, want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from lectern.operators import library
    from lectern.sources import tables

    plan = library.links(tables.link(spark, sf), tables.target_line(spark, sf), tables.book(spark, sf), 7)._jdf.queryExecution().toString()
    assert "EqualTo(l_orderkey,7)" in plan
    assert "l_comment" not in plan
