"""Compare a Spark result with DuckDB on the same parquet files."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """``None`` when names, kinds and rows agree, else a short explanation."""
    spark_names, spark_rows = _bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    duck_names, duck_rows = _bag([d[0] for d in cursor.description], cursor.fetchall())
    if spark_names != duck_names:
        return f"columns {spark_names} != {duck_names}"
    if spark_rows != duck_rows:
        left, right = spark_rows - duck_rows, duck_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} vs {sum(duck_rows.values())} rows; only spark {sum(left.values())}: "
            f"{list(left)[:3]}; only sql {sum(right.values())}: {list(right)[:3]}"
        )
    kinds = dict(df.dtypes)
    for name, kind in [(d[0], str(d[1])) for d in cursor.description]:
        spark_kind = kinds[name]
        expected = {
            "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
        }.get(spark_kind)
        if expected != kind:
            return f"type of {name}: {spark_kind} vs {kind}"
    return None


def main(argv: list[str]) -> None:
    from tabwright.queries import QUERIES, SQL
    from tabwright.session import local_session

    folder = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = differences(df, con, SQL[name]) if name in SQL else f"rows {df.count()} (no sql)"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed = problem is not None and not problem.startswith("rows ")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
