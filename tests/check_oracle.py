"""Run queries and their SQL side by side: python tests/check_oracle.py [folder] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' when columns, row count and values agree, else what differs."""
    names = sorted(df.columns)
    mine = [tuple(row) for row in df.select(*names).collect()]
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(row[i] for i in order) for row in result.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    if mine:
        kinds = [{type(v).__name__ for v in col if v is not None} for col in zip(*mine)]
        others = [{type(v).__name__ for v in col if v is not None} for col in zip(*theirs)]
        if kinds != others:
            return f"types {list(zip(names, kinds))} against {others}"
    mine.sort(key=_key)
    theirs.sort(key=_key)
    bad = [(a, b) for a, b in zip(mine, theirs) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"[:600] if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as se

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = se.oracle_sql()
    failed = 0
    for name, query in se.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            note = compare(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:
            note = f"error {type(error).__name__}: {str(error)[:500]}"
        good = not note or note.startswith("rows only")
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
