import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    """Row counts, names and values, as texts of plain numbers, on the smallest tables."""
    import decimal
    from pathlib import Path

    def plain(v):
        if isinstance(v, decimal.Decimal):
            return format(v.normalize(), "f")
        return repr(round(v, 8)) if isinstance(v, float) else str(v)

    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    with duckdb.connect() as c:
        c.execute("SET timezone = 'UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        result = c.sql(entry.oracle_sql()[name])
        at = [result.columns.index(x) for x in columns]
        assert sorted(result.columns) == columns
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
