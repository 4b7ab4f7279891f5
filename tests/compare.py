"""Run registered queries beside their SQL twins and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{round(value, 6) + 0.0:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in value) + "]"
    if value is None:
        return "null"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canonical(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, connection=None):
    """(ok, message) for one query."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    cursor = (connection or duck(sf_dir)).execute(sql)
    want = cursor.fetchall()
    want_columns = [d[0] for d in cursor.description]
    duck_spent = time.time() - start - spent
    if sorted(df.columns) != sorted(want_columns):
        return False, f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a == b:
        return True, f"{len(a)} rows, {spent:.1f}s (sql {duck_spent:.1f}s)"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, f"rows {len(a)} != {len(b)}\n   spark only: {only_a[:3]}\n   sql only:   {only_b[:3]}"


def main(argv):
    import __spark_entry__ as entry
    from mutspan.session import build_session

    sf = argv[0]
    wanted = argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, sf, name, fn, sqls.get(name), connection)
        except Exception as error:  # a broken query must not hide the others
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1:]) else 0)
