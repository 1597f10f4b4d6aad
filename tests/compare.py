"""Run registered queries against their SQL twins: python -m tests.compare SF_DIR [key…]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from lakeaudit.plans import params as P


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in P.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def check(spark, con, sf: str, key: str, query, sql: str) -> str | None:
    """None if both give the same bag of rows, else what differs."""
    df = query(spark, sf)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = bag(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        extra, lacking = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; extra {extra}; lacking {lacking}"
    return None if mine else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from lakeaudit.session import local_session

    sf, keys = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for key, query in entry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            problem = check(spark, con, sf, key, query, entry.oracle_sql()[key])
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{key:24s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
