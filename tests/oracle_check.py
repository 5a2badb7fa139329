"""Run every catalogue query on Spark and its DuckDB oracle, and compare
row count, column names and order-insensitive values (as the driver does)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return str(int(v)) if v.is_integer() else repr(round(v, 9))  # pandas turns whole numbers beside a NULL into floats
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 else str(v)
    try:
        if pd.isna(v):
            return "None"
    except (TypeError, ValueError):
        pass
    return str(v)


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark, sf_dir: str, names=None, verbose: bool = True) -> dict[str, str]:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            s = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"spark error {type(e).__name__}: {str(e)[:200]}"
            continue
        if name not in sql:
            out[name] = f"rows-only {len(s)}"
            continue
        try:
            d = con.sql(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = f"duckdb error {str(e)[:300]}"
            continue
        if sorted(s.columns) != sorted(d.columns):
            out[name] = f"columns {sorted(s.columns)} vs {sorted(d.columns)}"
        elif len(s) != len(d):
            out[name] = f"rows {len(s)} vs {len(d)}"
        else:
            a, b = canon(s), canon(d)
            if a == b:
                out[name] = "match"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                out[name] = f"values differ {diff}"
        if verbose:
            print(f"{name}: {out[name]} ({time.time() - t:.1f}s)", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from razao.session import local_session
    spark = local_session(8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v != "match"}
    print(f"{len(res) - len(bad)}/{len(res)} match")
    for k, v in bad.items():
        print("  ", k, v)
