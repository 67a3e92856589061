"""Run registered queries in Spark and their SQL in DuckDB over the same tables and compare rows."""

import glob
import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def key(row):
    return tuple((v is None, str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)) for v in row)


def same(x, y):
    if isinstance(x, float) and isinstance(y, (int, float)) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=2e-6)
    return x == y


def difference(spark, con, sf_dir, query, sql):
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in got_cols) for r in df.collect()), key=key)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} and {sorted(names)}"
    at = [names.index(c) for c in got_cols]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
    for a, b in zip(got, want):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return ""
