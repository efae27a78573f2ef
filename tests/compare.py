"""Runs a registered query and its SQL twin and compares rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def twin_connection(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def difference(df, connection, sql: str) -> str:
    """Empty when names, types and the bag of rows agree; else what does not."""
    names = sorted(df.columns)
    kinds = {field.name: KINDS.get(field.dataType.simpleString(), field.dataType.simpleString()) for field in df.schema}
    result = connection.execute(sql)
    twin_kinds = {d[0]: str(d[1]) for d in result.description}
    if names != sorted(twin_kinds):
        return f"columns {names} against {sorted(twin_kinds)}"
    twin_names = [d[0] for d in result.description]
    places = [twin_names.index(name) for name in names]
    expected = Counter(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    actual = Counter(repr(tuple(row[name] for name in names)) for row in df.collect())
    odd = [f"{n}: {kinds[n]} against {twin_kinds[n]}" for n in names if kinds[n] != twin_kinds[n]]
    if expected != actual:
        only, missing = actual - expected, expected - actual
        return (
            f"{sum(actual.values())} rows against {sum(expected.values())}; only here {sum(only.values())}: "
            f"{sorted(only)[:2]}; only there: {sorted(missing)[:2]} {odd}"
        )
    return "; ".join(odd)
