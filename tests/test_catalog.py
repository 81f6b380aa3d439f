"""Every query that SQL can express gives the SQL's rows, over whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from dossier.plans.catalog import QUERIES
from dossier.plans.oracles import ORACLES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    return round(float(v), 3) + 0.0 if type(v).__name__ in ("float", "Decimal") else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    found = sql.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    expected = Counter(str(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
    assert Counter(str(tuple(plain(x) for x in r)) for r in df.select(*names).collect()) == expected
