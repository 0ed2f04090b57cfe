"""Runs a registered query beside its reference SQL and compares all values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (2, repr(v + 0.0))
    return (3, str(v))


def differences(spark, con, build, sql: str, sf_dir: str) -> tuple[list[str], int]:
    """What differs between both results, and the number of rows."""
    df = build(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, row, strict=True)) for row in cur.fetchall()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"], len(got)
    if len(got) != len(want):
        return [f"rows {len(got)} <> {len(want)}"], len(got)
    order = sorted(names)
    a = sorted(tuple(_cell(r[c]) for c in order) for r in got)
    b = sorted(tuple(_cell(r[c]) for c in order) for r in want)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    out = [f"{len(bad)} rows differ, e.g. {x} <> {y}" for x, y in bad[:2]]
    con.execute(f"CREATE OR REPLACE TEMP VIEW _types AS {sql}")
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE _types").fetchall()}
    same = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
    }
    for c, kind in df.dtypes:
        if same.get(kind, kind.upper()) != kinds[c].replace(", ", ","):
            out.append(f"type of {c}: {kind} <> {kinds[c]}")
    return out, len(got)
