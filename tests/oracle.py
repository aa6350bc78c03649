"""Comparison of a query with its SQL on DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 8)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def same_rows(df, con, sql):
    """None, or what differs."""
    columns = sorted(df.columns)
    spark_rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    sql_rows = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    if spark_rows == sql_rows:
        return None
    only = [x for x in spark_rows if x not in set(sql_rows)][:3], [x for x in sql_rows if x not in set(spark_rows)][:3]
    return f"{len(spark_rows)} and {len(sql_rows)} rows, only on one side: {only}"
