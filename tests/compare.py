"""Runs registered queries against their SQL twins on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir, fn, sql):
    """Empty string if names, types (numeric kind) and all values agree, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    types = {c[0]: str(c[1]).lower() for c in found.description}
    want = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} / {names}"
    kinds = {"double": ("double", "float"), "bigint": ("bigint", "hugeint", "number"), "int": ("integer", "number"),
             "string": ("varchar", "string"), "boolean": ("bool", "boolean")}
    notes = [f"{n}: {t} / {types[n]}" for n, t in df.dtypes
             if types[n] not in kinds.get(t, ()) or types[n] == "hugeint"]
    a, b = sorted_rows(df.columns, got), sorted_rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]}"
    return f"types {notes}" if notes else ""


def main(sf_dir, names):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.perf_counter()
        try:
            if name in oracles:
                result = differences(spark, con, sf_dir, queries[name], oracles[name]) or "ok"
            else:
                result = f"no sql, {len(queries[name](spark, sf_dir).collect())} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"ERROR {str(error)[:600]}"
        print(f"{name:28s} {time.perf_counter() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
