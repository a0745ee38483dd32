"""Run every registered query next to its DuckDB SQL and compare the rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def compare(spark, connection, sf_dir, query, sql) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    got = normalised(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = normalised(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"rows {len(got)} != {len(want)}; first differences {odd}"
    return None if got else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, connection = make_session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            problem = (
                "no oracle"
                if sql is None
                else compare(spark, connection, sf_dir, entry.queries()[name], sql)
            )
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent))
    raise SystemExit(main())
