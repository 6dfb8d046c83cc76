"""Order-free comparison of a Spark result with DuckDB's."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert [p for p in zip(got, want) if p[0] != p[1]][:3] == []
