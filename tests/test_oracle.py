"""Every panel query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tessera import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, spark, sf_dir, duck):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted("|".join(shown(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert ours == sorted("|".join(shown(r[i]) for i in place) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_others_have_rows(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0
