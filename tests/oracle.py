"""Comparing a query's rows with its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return db


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(map(show, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True))


def same(found: pa.Table, expected: pa.Table) -> None:
    assert sorted(found.column_names) == sorted(expected.column_names)
    a, b = rows_of(found), rows_of(expected)
    assert len(a) == len(b), f"{len(a)} rows, not {len(b)}"
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differ, f"{len(differ)} of {len(a)} rows differ, first {differ[0]}"
    kinds = {n: found.schema.field(n).type for n in found.column_names}
    for n, kind in kinds.items():
        other = expected.schema.field(n).type
        alike = [pa.types.is_integer, pa.types.is_floating, lambda t: pa.types.is_string(t) or pa.types.is_large_string(t)]
        assert any(f(kind) and f(other) for f in alike) or kind == other, (n, kind, other)
