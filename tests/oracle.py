"""Run a query on Spark and its SQL on DuckDB and compare the rows."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import time
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


LAST: dict[str, float] = {}


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6f}" if v != int(v) else f"{v:.1f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(v) -> str:
    return {"bool": "bool", "int": "int", "float": "float", "Decimal": "decimal", "str": "str"}.get(type(v).__name__, type(v).__name__)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows), [
        next((kind(r[i]) for r in rows if r[i] is not None), "none") for i in order]


def compare(df, sql: str, con) -> str | None:
    """None when equal, else a short description of the difference."""
    start = time.time()
    s_cols, s_rows, s_kinds = rows_of(df.columns, [tuple(r) for r in df.collect()])
    LAST["spark"] = time.time() - start
    cur = con.execute(sql)
    d_cols, d_rows, d_kinds = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} vs {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"row counts {len(s_rows)} vs {len(d_rows)}; spark {[x for x in s_rows[:400] if x not in set(d_rows)][:2]} duckdb {[x for x in d_rows[:400] if x not in set(s_rows)][:2]}"
    if s_kinds != d_kinds:
        return f"types {list(zip(s_cols, s_kinds))} vs {d_kinds}"
    if s_rows != d_rows:
        ss, ds = set(s_rows), set(d_rows)
        return f"values differ: {sum(x not in ds for x in s_rows)} rows; spark {[x for x in s_rows if x not in ds][:2]} duckdb {[x for x in d_rows if x not in ss][:2]}"
    if not s_rows:
        return "EMPTY"
    return None
