"""Run registered queries next to their SQL twins and compare names, types and values."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "bigint",
    "varchar": "string", "string": "string", "double": "double", "boolean": "boolean",
    "float": "float", "date": "date", "timestamp_ntz": "timestamp", "blob": "binary", "binary": "binary",
}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, con, folder, fn, sql) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not got:
        return "no rows"
    if sql is None:
        return None
    rel = con.sql(sql)
    want_types = {n: KINDS.get(str(t).lower(), str(t).lower()) for n, t in zip(rel.columns, rel.types)}
    want = rows_of(rel.columns, rel.fetchall())
    if got_types != want_types:
        return f"types {sorted(set(got_types.items()) ^ set(want_types.items()))}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"columns {sorted(df.columns)}\n  spark {str(a)[:400]}\n  sql   {str(b)[:400]}"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from liveops.session import session
    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = session(master="local[8]", **{
        "spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false",
        "spark__driver__memory": "12g", "spark__ui__showConsoleProgress": "false",
        **({"spark__liveops__hotRows": os.environ["HOT"]} if "HOT" in os.environ else {}),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            problem = check(spark, con, folder, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:900]}"
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'BAD' if problem else 'ok '} {kind} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
