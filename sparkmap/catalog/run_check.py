"""Compare registered queries with their SQL: python -m sparkmap.catalog.run_check SF_DIR [name ...]."""

from __future__ import annotations

import os
import sys
import time

import pandas as pd


def as_frame(rows: pd.DataFrame) -> pd.DataFrame:
    out = rows.reindex(sorted(rows.columns), axis=1)
    for c in out.columns:
        if str(out[c].dtype) in ("Int64", "int32", "int64", "Int32"):
            out[c] = out[c].astype("float64")
    return out.sort_values(list(out.columns), na_position="last").reset_index(drop=True)


def mismatch(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    got, want = as_frame(got), as_frame(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} / {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(got)} differ in {c}: {got.loc[i].to_dict()} / {want.loc[i].to_dict()}"
    return None


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(sf_dir: str, names: list[str]) -> int:
    from sparkmap.catalog import load
    from sparkmap.session import build_session

    queries, oracles = load()
    conf = {"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    if "SHUFFLE_PARTITIONS" in os.environ:
        conf["spark.sql.shuffle.partitions"] = os.environ["SHUFFLE_PARTITIONS"]
    spark = build_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names or list(queries):
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and go on
            failed += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        ts = time.time() - t
        if name not in oracles:
            print(f"rows  {name} {len(got)} [{ts:.1f}s]", flush=True)
            continue
        t = time.time()
        try:
            why = mismatch(got, con.execute(oracles[name]).df())
        except Exception as e:
            why = f"oracle: {str(e)[:800]}"
        failed += why is not None
        print(f"{'ok   ' if why is None else 'DIFF '} {name} {len(got)} [{ts:.1f}s / {time.time() - t:.1f}s] {why or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
