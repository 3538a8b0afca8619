"""Side-by-side comparison of a registered Spark query and its DuckDB text."""

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda c: names[c])
    out = [tuple(plain(r[c]) for c in order) for r in rows]
    return [names[c] for c in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, sf: str, name: str, con=None):
    """(matches, message) for one query."""
    from marketloom.registry import QUERIES, SQL

    df = QUERIES[name](spark, sf)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return len(got) > 0, f"rows only: {len(got)}"
    con = con or duck(sf)
    res = con.execute(SQL[name])
    onames = [d[0] for d in res.description]
    onames, want = rows_of(onames, res.fetchall())
    if names != onames:
        return False, f"columns {names} vs {onames}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    return len(got) > 0, f"{len(got)} rows equal"


def main():
    import argparse

    from marketloom import registry
    from marketloom.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--partitions", type=int, default=8)
    args = ap.parse_args()
    registry.load()
    spark = build_session("local[8]", args.partitions)
    con, failed = duck(args.sf), []
    for name in args.names or list(registry.QUERIES):
        t = time.time()
        try:
            ok, message = compare(spark, args.sf, name, con)
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.1f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
