"""Compare registered queries with their SQL: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    """A value with its type, so that 1 and 1.0, or 0.0 and -0.0, do not pass as equal."""
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return type(value).__name__, repr(value)


def ordered(rows):
    return sorted(tuple(plain(v) for v in r) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    names = sorted(df.columns)
    got = ordered(df.select(*[f"`{n}`" for n in names]).collect())
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = ordered([tuple(r[i] for i in order) for r in result.fetchall()])
    told = f"{len(got)} rows, spark {spent:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(columns) != names:
        return False, f"{told}; columns {names} / {sorted(columns)}"
    if got != want:
        wrong = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{told}; sql has {len(want)} rows; first differences {wrong}"
    return True, told


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from termweave.runtime import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            good, told = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            good, told = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not good
        print("ok  " if good else "FAIL", name, told, flush=True)
    print("failed:", failed)
