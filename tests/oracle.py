"""Run a query in Spark and its SQL in DuckDB over the same tables and compare.

As a script: python tests/oracle.py SF_DIR [NAME...] prints a line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings issues comments issue_keywords corpus_keywords search_parameters artifacts spec_pages deleted_issues people eval_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, decimal.Decimal):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if x is not None else None


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""


def main() -> None:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from tallyloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    q, sql = e.queries(), e.oracle_sql()
    for name in names or q:
        t = time.time()
        try:
            if name in sql:
                said = compare(spark, con, q[name], sql[name], sf_dir) or f"equal ({q[name](spark, sf_dir).count()} rows)"
            else:
                said = f"no SQL, {q[name](spark, sf_dir).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__}: {str(x)[:700]}"
        print(f"{name}: {said} [{time.time() - t:.1f} s]", flush=True)


if __name__ == "__main__":
    main()
