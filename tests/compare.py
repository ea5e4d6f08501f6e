"""Runs registered queries against their reference SQL and compares the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "∅"
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    cells = [[_cell(v) for v in frame[c].astype(object).tolist()] for c in columns]
    return sorted(zip(*cells)) if columns else []


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    mine, theirs = rows_of(spark_frame), rows_of(sql_frame)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows; e.g. {sorted(set(mine) ^ set(theirs))[:4]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tallyspark.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    only = sys.argv[1:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        began = time.time()
        try:
            mine = run(spark, sf_dir).toPandas()
            took = time.time() - began
            if name in sql:
                began = time.time()
                theirs = con.execute(sql[name]).df()
                problem = difference(mine, theirs)
                note = f"sql {time.time() - began:.2f}s"
            else:
                problem, note = None, "rows only"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, note, took, mine = f"{type(error).__name__}: {str(error)[:700]}", "", time.time() - began, []
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:42s} {len(mine):7d} rows {took:6.2f}s {note} {problem or ''}", flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
