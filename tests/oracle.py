"""Compare a query with its SQL over the same tables; also usable as a script: oracle.py FOLDER NAME..."""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime, timezone
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def plain(v):
    """A comparable form of a value of either engine."""
    if isinstance(v, datetime):
        return (v.astimezone(timezone.utc).replace(tzinfo=None) if v.tzinfo else v).isoformat()
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(f"{v:.15g}") if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return c


def compare(spark, folder: str, name: str, query, sql: str):
    """(missing from Spark, extra in Spark, rows expected)."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(folder).execute(sql)
    cols = [x[0] for x in rel.description]
    want = rows_of(cols, rel.fetchall())
    assert sorted(cols) == sorted(df.columns), (name, cols, df.columns)
    return want - got, got - want, sum(want.values())


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, queries, oracles = session(), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    names = [n for n in queries if any(n.startswith(x) for x in names)]
    bad = []
    for n in names:
        t = time.time()
        try:
            if n not in oracles:
                print(f"{n}: {queries[n](spark, sys.argv[1]).count()} rows, no SQL, {time.time() - t:.1f} s")
                continue
            missing, extra, total = compare(spark, sys.argv[1], n, queries[n], oracles[n])
            ok = not missing and not extra
            print(f"{n}: {'ok' if ok else 'DIFFERS'}, {total} rows, {time.time() - t:.1f} s", flush=True)
            if not ok:
                bad.append(n)
                print("   missing", sum(missing.values()), list(missing)[:2], "\n   extra", sum(extra.values()), list(extra)[:2])
        except Exception as e:
            bad.append(n)
            print(f"{n}: FAILED {str(e)[:600]}")
    print("bad:", bad)
