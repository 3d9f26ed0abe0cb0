from pathlib import Path

import duckdb

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry.entry(spark)
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert rows.columns == ["id", "label"]
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(entry.oracle_sql()["cc_directed"]).fetchall())
    assert set(entry.oracle_sql()) <= set(entry.queries())
