"""Compare queries with their SQL: python tests/check_oracle.py [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v is pd.NaT else str(v)).fillna("")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = []
    for c in got.columns:
        a, b = got[c], want[c]
        if pd.api.types.is_integer_dtype(a) != pd.api.types.is_integer_dtype(b) and len(a):
            kinds.append(f"{c}: {a.dtype} vs {b.dtype}")
    got, want = frame(got), frame(want)
    bad = []
    for c in got.columns:
        if got[c].dtype == float:
            same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        else:
            same = got[c].astype(str) == want[c].astype(str)
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            bad.append(f"{c}: {int((~same).sum())} differ, e.g. {got[c][i]!r} vs {want[c][i]!r}")
    if bad:
        return "; ".join(bad[:4])
    return ("(types) " + "; ".join(kinds)) if kinds else None


def main(prefixes: list[str]) -> int:
    from genemill.session import local_session

    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(shuffle_partitions=8)
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if os.environ.get("CHECK_SQL_ONLY") and name not in oracle:
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            note = None
            if name in oracle:
                note = difference(got, con.sql(oracle[name]).df())
                status = "ok" if note is None else ("types" if note.startswith("(types)") else "DIFF")
            else:
                status = "rows-only"
            t2 = time.time()
        except Exception as e:  # report and go on to the next query
            status, note, t1, got = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", time.time(), []
            t2 = t1
        if status in ("DIFF", "ERROR"):
            failed += 1
        print(f"{status:9s} {name:40s} rows={len(got):6d} spark={t1-t0:5.1f}s sql={t2-t1:5.1f}s {note or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
