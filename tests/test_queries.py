from __future__ import annotations

import duckdb
import pytest

from ledgerloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else "null" if v is None else str(list(v)) if isinstance(v, list | tuple) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    found = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        expected = con.sql(plans.SQL[name])
        assert sorted(expected.columns) == columns
        want = rows(expected.select(*(f'"{c}"' for c in columns)).fetchall())
    assert rows(found.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
