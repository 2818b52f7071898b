"""Spark result vs DuckDB oracle: row count, column names, and values
compared order-insensitively (columns sorted by name, rows sorted)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, decimal.Decimal):
        return (1, format(v.normalize(), "f"))
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 9)))
    if isinstance(v, int):
        return (1, format(decimal.Decimal(v), "f"))
    if isinstance(v, dt.datetime):
        return (1, v.replace(tzinfo=None).isoformat())
    return (1, str(v))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, builder, sql: str, con=None):
    con = con or duck(sf_dir)
    df = builder(spark, sf_dir)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(sql)
    o_cols, o_rows = canon(res.columns, res.fetchall())
    problems = []
    if s_cols != o_cols:
        problems.append(f"columns spark={s_cols} oracle={o_cols}")
    if len(s_rows) != len(o_rows):
        problems.append(f"rows spark={len(s_rows)} oracle={len(o_rows)}")
    elif s_rows != o_rows:
        diff = [(a, b) for a, b in zip(s_rows, o_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return len(s_rows), problems


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from ledgerlens.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:] or None
    spark = local_session(8)
    qs, oq = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in qs:
        if only and not any(name.startswith(o) for o in only):
            continue
        if name not in oq:
            print(f"{name}: no oracle")
            continue
        try:
            n, problems = compare(spark, sf_dir, name, qs[name], oq[name], con)
        except Exception as e:  # report and continue
            n, problems = -1, [f"error {type(e).__name__}: {str(e)[:300]}"]
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name} rows={n} {'; '.join(problems)}", flush=True)
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
