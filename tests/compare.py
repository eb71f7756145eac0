"""Run a query in Spark and its SQL twin in DuckDB and compare schema and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _sortable(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(arrow):
    names = sorted(arrow.schema.names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, sorted((tuple(_cell(v) for v in r) for r in zip(*columns)), key=_sortable)


def differences(spark_df, con, sql: str) -> list[str]:
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).fetch_arrow_table()
    out = []
    g_types = {f.name: str(f.type).replace("large_", "") for f in got.schema}
    w_types = {f.name: str(f.type).replace("large_", "") for f in want.schema}
    if sorted(g_types) != sorted(w_types):
        return [f"columns differ: {sorted(g_types)} / {sorted(w_types)}"]
    for n in g_types:
        a, b = g_types[n], w_types[n]
        if a != b and not (a.startswith(("list", "struct", "map")) and b.startswith(("list", "struct", "map"))):
            out.append(f"type of {n}: {a} / {b}")
    _, g = rows_of(got)
    _, w = rows_of(want)
    if len(g) != len(w):
        out.append(f"rows: {len(g)} / {len(w)}")
    gs, ws = set(g), set(w)
    bad = [r for r in g if r not in ws], [r for r in w if r not in gs]
    if bad[0] or bad[1] or (not out and g != w):
        out.append(f"{len(bad[0])} rows only in Spark, {len(bad[1])} only in SQL, of {len(g)}; columns {sorted(g_types)}")
        out += [f"  spark {r}" for r in bad[0][:3]] + [f"  sql   {r}" for r in bad[1][:3]]
    return out
