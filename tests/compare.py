"""Run the registered queries against their SQL counterparts; also usable as a script: compare.py [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(v)
    return repr(v)


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def difference(spark, con, run, sql: str, sf_dir: str) -> tuple[str | None, int, list[str]]:
    df = run(spark, sf_dir)
    mine = table_of(df.columns, df.collect())
    cur = con.execute(sql)
    theirs = table_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}", len(mine[1]), mine[0]
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}", len(mine[1]), mine[0]
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {str(bad[0])[:600]}", len(mine[1]), mine[0]
    return None, len(mine[1]), mine[0]


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tremorlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name not in oracles:
                problem, n = None, run(spark, sf_dir).count()
            else:
                problem, n, _ = difference(spark, con, run, oracles[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.2f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
