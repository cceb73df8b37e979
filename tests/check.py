"""Compare catalog queries with their SQL on one scale factor.

    python tests/check.py SF [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """'' when both sides agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    mine = normalise(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = normalise([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ, first {str(bad[0])[:600]}"
    kinds = {type(x) for r in theirs[1][:50] for x in r} ^ {type(x) for r in mine[1][:50] for x in r}
    return f"types differ: {kinds}" if kinds else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from replylens.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", spark_driver_memory="20g", spark_sql_shuffle_partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).collect()
                diff = "" if rows else "no rows"
                print([r.asDict() for r in rows[:3]])
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok " if not diff else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {diff}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
