"""Every engine query against its SQL in DuckDB."""

import duckdb
import pytest

import fotolith.plans.catalog_queries  # noqa: F401  registers its queries
from fotolith.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def tidy(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    mine = sorted(tuple(tidy(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(tidy(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert mine == theirs
