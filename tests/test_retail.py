import duckdb
import pytest

from quern.plans import retail

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(retail.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(retail.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = retail.QUERIES[name](spark, SF)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(retail.QUERIES) <= set(__spark_entry__.queries())
