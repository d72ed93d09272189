"""Compares a query with its SQL."""

from pathlib import Path


def against_sql(spark, name, sf="/root/testdata/sf0.001"):
    """Rows of the query and of its SQL, in one order and with columns by name."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    mine = e.queries()[name](spark, sf).toPandas()
    theirs = con.sql(e.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).values.tolist()))
    return key(mine), key(theirs)
