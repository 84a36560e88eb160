"""Run registered queries against their SQL oracles and report each comparison.

Usage: ``python tests/check_oracles.py [name ...]``; the folder comes from ``CHECK_SF_DIR``.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from epitrove.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_session(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET threads TO 8")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if frame[column].dtype.kind == "f":
            frame[column] = frame[column].map(lambda v: None if pd.isna(v) else repr(float(v)))
        frame[column] = frame[column].map(lambda v: "∅" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE",
         "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE"}


def compare(ours, theirs) -> str:
    kinds = {name: KINDS.get(kind, kind) for name, kind in ours.dtypes}
    expected = dict(zip(theirs.columns, map(str, theirs.types)))
    left, right = ours.toArrow().to_pandas(types_mapper=_types), theirs.arrow()
    right = (right.read_all() if hasattr(right, "read_all") else right).to_pandas(types_mapper=_types)
    if set(left.columns) != set(right.columns):
        return f"COLUMNS {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"ROWS {len(left)} vs {len(right)}"
    left, right = normal(left), normal(right)
    if not left.equals(right):
        differing = (left != right).any(axis=1)
        return f"VALUES {int(differing.sum())} rows differ, e.g.\n{left[differing].head(3)}\n{right[differing].head(3)}"
    wrong = {n: (kinds[n], expected[n]) for n in kinds if kinds[n] != expected[n]}
    return f"ok {len(left)} rows" + (f" TYPES {wrong}" if wrong else "")


def _types(kind):
    import pyarrow as pa

    return {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(),
            pa.bool_(): pd.BooleanDtype()}.get(kind)


def main(names: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, connection = local_session(), oracle_session(folder)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    failures = 0
    for name in names or list(queries):
        began = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                verdict = compare(frame, connection.sql(oracles[name]))
            else:
                verdict = f"ok {frame.count()} rows, no oracle"
        except Exception as problem:  # report and go on with the next query
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        failures += not verdict.startswith("ok") or "TYPES" in verdict
        print(f"{name:32s} {time.time() - began:6.1f}s {verdict}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
