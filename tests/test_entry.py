import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(rows):
    def cell(v):
        if isinstance(v, float):
            return str(round(v, 5) + 0.0)
        return str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted("|".join(cell(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.SQL[name]})").df()
    want = want.astype(object).where(want.notna(), None)
    got = df.select(*(f"`{c}`" for c in columns)).toPandas()
    got = got.astype(object).where(got.notna(), None)
    assert cells(got.itertuples(index=False)) == cells(want.itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
