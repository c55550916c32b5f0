"""Run queries on Spark and their SQL on DuckDB, and compare rows exactly.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    """Columns sorted by name, rows sorted; types stay, so 1 and 1.0 differ."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([_value(r[i]) for i in order]) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
    if ours == theirs:
        return True, f"{len(ours[1])} rows"
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} against {theirs[0]}"
    left, right = sorted(set(ours[1]) - set(theirs[1])), sorted(set(theirs[1]) - set(ours[1]))
    return False, (f"{len(ours[1])} against {len(theirs[1])} rows, {len(left)} and {len(right)} unmatched\n"
                   + "\n".join(f"  spark  {r[:300]}" for r in left[:3]) + "\n"
                   + "\n".join(f"  duckdb {r[:300]}" for r in right[:3]))


def main(argv: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from stratalake.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        begin = time.perf_counter()
        try:
            same, note = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
        except Exception as error:  # noqa: BLE001
            same, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not same
        print(f"{'ok  ' if same else 'DIFF'} {name} {time.perf_counter() - begin:.1f}s {note}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
