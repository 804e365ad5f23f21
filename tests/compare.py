"""Side-by-side check of registered queries against their SQL: ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(value: object) -> str:
    if value is None:
        return "\\N"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def normalized(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """NULL when both sides agree, else a short description."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = normalized(df.columns, [tuple(r) for r in df.collect()])
    sql = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    want = normalized(columns, sql.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; extra {extra}; missing {missing}"
    return None if got else "no rows on either side"


def main() -> None:
    import __spark_entry__ as entry
    from mailstrata.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    con = oracle_connection(sf_dir)
    for name in names or list(entry.oracle_sql()):
        start = time.time()
        try:
            result = difference(spark, con, sf_dir, name)
        except Exception as exc:  # report and go on
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.time() - start:.1f}s"
              f"{'' if result is None else ' ' + result}", flush=True)


if __name__ == "__main__":
    main()
