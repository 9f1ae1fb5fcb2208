"""Run registered queries beside their SQL statements and compare the results.

    python run_checks.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from waymark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            files = f"{folder}/{t}.parquet" if Path(f"{folder}/{t}.parquet").is_file() else f"{folder}/{t}.parquet/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    rel = con.sql(sql)
    spark_types = {n: SAME_TYPE.get(t, t) for n, t in df.dtypes}
    sql_types = dict(zip(rel.columns, map(str, rel.types)))
    if spark_types != sql_types:
        diff = {k: (spark_types.get(k), sql_types.get(k)) for k in spark_types.keys() | sql_types.keys()}
        return f"schema {[(k, v) for k, v in diff.items() if v[0] != v[1]]}"
    a = canonical([tuple(r) for r in df.collect()], df.columns)
    b = canonical(rel.fetchall(), rel.columns)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"values {len(wrong)} of {len(a)}: {wrong[:2]}" if wrong else f"ok {len(a)}"


def main(argv: list[str]) -> int:
    from checks import ORACLES, QUERIES

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = database(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            result = compare(df, con, ORACLES[name]) if name in ORACLES else f"ok {len(df.collect())} (rows only)"
        except Exception as err:  # report and go on with the next query
            result = f"error {type(err).__name__}: {str(err)[:600]}"
        bad += not result.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{bad} wrong")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
