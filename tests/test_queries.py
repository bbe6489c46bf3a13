"""Each query against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from picmeta.operators.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Whole numbers alike, whatever their type."""
    return int(v) if isinstance(v, (float, Decimal)) and v == v and v == int(v) else float(v) if isinstance(v, Decimal) else v


def rows(found):
    return sorted(str([plain(v) for v in r]) for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    run, sql = QUERIES[name]
    got, want = run(spark, SF), c.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*(f"`{n}`" for n in names)).collect()) == rows(want.project(", ".join(f'"{n}"' for n in names)).fetchall())
