"""Every catalogue query against its SQL at the smallest scale, as the driver compares them."""

import duckdb
import pytest

from cairngrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    return f"{v + 0.0:.7g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in catalogue.ORACLE:
        assert got
        return
    db.execute(catalogue.ORACLE[name])
    names = [c[0] for c in db.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in db.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert catalogue.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("name", "rows"), [("q49_ring_line", 73), ("q50_wedge", 21), ("q51_sectors", 168)])
def test_all_suppliers_are_computed_and_checked(spark, name, rows):
    """At a size with many suppliers."""
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"create view supplier as select * from read_parquet('{sf}/supplier.parquet')")
    suppliers = con.execute("select count(*) from supplier").fetchone()[0]
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert suppliers > 40 and len(got) == suppliers * rows
    con.execute(catalogue.ORACLE[name])
    names = [c[0] for c in con.description]
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in con.fetchall())
