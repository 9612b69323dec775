"""Compare a registered query with its SQL twin, as the driver does."""

from __future__ import annotations

import datetime
import math
import os

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return connection


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(cells, key=repr)


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


# Names of the same type in both engines.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def difference(df, connection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    names = df.columns
    rows = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} against {sorted(expected_names)}"
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != expected_types[name]:
            return f"type of {name}: {kind} against {expected_types[name]}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    got, want = sorted_rows(rows, names), sorted_rows(expected, expected_names)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ in {sorted(names)}, first {wrong[0][0]} against {wrong[0][1]}"
    return None
