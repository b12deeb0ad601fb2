"""Every query against its SQL on DuckDB, on a small table."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = rows(columns, cursor.fetchall())
    have = rows(got.columns, got.collect())
    assert len(have) == len(want) and len(want) > 0
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float | int) and isinstance(y, float | int) and math.isclose(x, y, abs_tol=2e-5), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1
