"""Run registered queries and their SQL on one data directory and compare.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, int):
        return str(value)
    return f"{type(value).__name__}:{value}"


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, run, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = run(spark, sf_dir)
    got = as_rows(df.columns, df.collect())
    spark_time = time.time() - started
    if sql is None:
        return True, f"rows only: {len(got)} ({spark_time:.1f}s)"
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = as_rows(names, cur.fetchall())
    note = f"{len(got)} rows, spark {spark_time:.1f}s, sql {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = {
        f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
        if {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
            "boolean": "BOOLEAN"}.get(f.dataType.simpleString(), "?") != types[f.name]
    }
    if odd:
        note += f" types {odd}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return False, f"{note}; want {len(want)}\n   only spark {extra}\n   only sql {missing}"
    return True, note


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from lexspark.session import builder

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        builder("compare").master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", "/tmp/lex-warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    sqls, failed = oracle_sql(), []
    for name, run in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            ok, note = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
