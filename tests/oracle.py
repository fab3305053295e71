"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _rows(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    plain = lambda v: (0, "") if v is None or isinstance(v, float) and math.isnan(v) else (1, repr(float(v))) if isinstance(v, float) or type(v).__name__ == "Decimal" else (1, str(v))
    return names, sorted(tuple(map(plain, r)) for r in zip(*columns))


def same(df, sql: str, connection) -> str | None:
    """What differs, or None."""
    found = connection.sql(sql).arrow()
    got, want = _rows(df.toArrow()), _rows(found.read_all() if hasattr(found, "read_all") else found)
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        return f"{len(got[1])} and {len(want[1])} rows; " + str([(a, b) for a, b in zip(got[1], want[1]) if a != b][:2])
    return None
