"""Compare every registered query with its SQL counterpart: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from claimspark.session import build_session
from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPE_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    seconds = time.time() - started
    if name not in ORACLES:
        return f"ROWS {len(rows):>7} {seconds:6.1f}s"
    relation = connection.sql(ORACLES[name])
    if sorted(relation.columns) != columns:
        return f"FAIL columns {columns} != {sorted(relation.columns)}"
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPE_NAMES.get(t, t) != types[c]}
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=_key)
    bad = [(x, y) for x, y in zip(rows, expected) if x != y]
    if len(rows) != len(expected) or bad or wrong:
        near = sum(
            all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9)) for p, q in zip(x, y))
            for x, y in bad
        )
        return f"FAIL rows {len(rows)} vs {len(expected)}, different {len(bad)} (close {near}), types {wrong}\n   {bad[:2]}"
    return f"ok   {len(rows):>7} {seconds:6.1f}s"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark_ui_enabled="false", spark_sql_shuffle_partitions="8", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    for name in names:
        try:
            result = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:32} {result}", flush=True)


if __name__ == "__main__":
    main()
