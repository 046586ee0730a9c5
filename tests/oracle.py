"""Run registered queries against their DuckDB twins: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


SPENT: list[float] = []


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    return str(value)


def canonical(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def digest(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:12]


def compare(spark, con, name, query, sql, folder) -> str:
    """Empty text when equal, otherwise what differs."""
    df = query(spark, folder)
    start = time.time()
    collected = df.collect()
    SPENT.append(time.time() - start)
    columns, mine = canonical(df.columns, collected)
    if sql is None:
        return "" if mine else "no rows"
    cursor = con.execute(sql)
    theirs_columns, theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if columns != theirs_columns:
        return f"columns {columns} != {theirs_columns}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        return f"rows {len(mine)} vs {len(theirs)}; only spark {[x[:400] for x in only_a]}; only sql {[x[:400] for x in only_b]}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    if not mine:
        return "both empty"
    return "" if types else "no types"


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from backglot.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(os.environ.get("BENCH_CPUS", 8))
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s (collect {SPENT[-1] if SPENT else 0:.1f}s) {problem}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
