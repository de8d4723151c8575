"""Compares a Spark query with its SQL run by DuckDB over the same files."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "as_tuple"):  # a decimal
        return float(f"{float(x):.9g}")
    return x


def _sorted(rows):
    return sorted((tuple(_plain(x) for x in r) for r in rows), key=repr)


def assert_same(frame, sql, data=DATA):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    expected = [[r[names.index(c)] for c in sorted(names)] for r in result.fetchall()]
    actual = frame.select(*[f"`{c}`" for c in sorted(names)]).collect()
    assert len(actual) == len(expected)
    assert _sorted(actual) == _sorted(expected)
    assert actual, "the data doesn't exercise the query"
