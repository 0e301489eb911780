"""Run registered queries on Spark and their oracle SQL on DuckDB and compare columns, types and rows.

    python tests/parity.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as registry  # noqa: E402
from landlens.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {
    "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "hugeint": "int",
    "double": "double", "string": "text", "varchar": "text", "boolean": "bool",
}


def test_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(rows, order):
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = registry.queries()[name](spark, sf_dir)
    names = df.columns
    found = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return bool(found), f"{name}: rows only, {len(found)} rows, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    wanted_names = [d[0] for d in cur.description]
    wanted_types = [str(d[1]).lower() for d in cur.description]
    wanted = cur.fetchall()
    duck_took = time.time() - start
    head = f"{name}: {len(found)} rows, spark {took:.1f}s, duckdb {duck_took:.1f}s"
    if sorted(names) != sorted(wanted_names):
        return False, f"{head}: columns {sorted(names)} != {sorted(wanted_names)}"
    types = dict(df.dtypes)
    exact = {"int": "integer", "string": "varchar"}
    off = [
        (n, types[n], t)
        for n, t in zip(wanted_names, wanted_types)
        if exact.get(types[n], types[n]) != t
    ]
    if off:
        return False, f"{head}: types {off}"
    order = sorted(names)
    mine = _rows(found, [names.index(n) for n in order])
    theirs = _rows(wanted, [wanted_names.index(n) for n in order])
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        diff = len(set(mine) ^ set(theirs))
        return False, f"{head}: {len(theirs)} wanted, {diff} differ\n  {order}\n  spark {only_mine}\n  duck  {only_theirs}"
    return True, head


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("parity", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(test_dir(args.sf))
    names = args.names or list(registry.queries())
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, test_dir(args.sf))
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{name}: {type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", text, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
