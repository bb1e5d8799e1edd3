"""Every query of the library's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from weftline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations pages labels benchmark embeddings".split()


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLE:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canon(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
