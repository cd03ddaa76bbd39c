"""Runs registered queries beside their SQL twins: ``python tests/check_queries.py [--chunked] [folder] [name ...]``.

``--chunked`` sets the size limits so low that every ordered scan is cut into chunks and every lookup is salted.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from fleetlens import settings  # noqa: E402

if __name__ == "__main__" and "--chunked" in sys.argv:  # before the operators take the limits as their defaults
    sys.argv.remove("--chunked")
    settings.GROUP_ROWS, settings.LOOKUP_ROWS, settings.HOT_ROWS = 40, 4, 20

import __spark_entry__ as entry  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if value is None or isinstance(value, (int, str, bool)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return str(value) if not hasattr(value, "__float__") else plain(float(value))


def canonical(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    return compare_rows(entry.queries()[name](spark, folder), con, name)


def compare_rows(df, con, name: str) -> tuple[bool, str]:
    got = canonical(df.collect(), df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no twin"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    want = canonical(result.fetchall(), columns)
    if got == want:
        return True, f"{len(got)} rows"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return False, f"{len(got)} / {len(want)} rows, {len(wrong)} differ, e.g. {wrong[:2]}"


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = [n for n in entry.queries() if not args or any(a in n for a in args)]
    failed = []
    for name in names:
        start = time.perf_counter()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {time.perf_counter() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
