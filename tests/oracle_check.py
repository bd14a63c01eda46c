"""Run registered queries and their SQL side by side and compare them."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when equal."""
    arrow = con.sql(sql).to_arrow_table()
    problems = []
    if sorted(df.columns) != sorted(arrow.column_names):
        return [f"columns {sorted(df.columns)} vs {sorted(arrow.column_names)}"]
    columns = sorted(arrow.column_names)
    spark_types = dict(df.dtypes)
    names = {"int64": "bigint", "int32": "int", "double": "double", "string": "string", "bool": "boolean",
             "large_string": "string"}
    for name in columns:
        theirs = str(arrow.schema.field(name).type)
        if names.get(theirs, theirs) != spark_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} vs {theirs}")
    mine = sorted(tuple(_plain(v) for v in r) for r in
                  (tuple(row[c] for c in columns) for row in df.collect()))
    want = sorted(tuple(_plain(v) for v in r) for r in zip(*[arrow.column(c).to_pylist() for c in columns]))
    if len(mine) != len(want):
        problems.append(f"rows {len(mine)} vs {len(want)}")
    if mine != want:
        both = set(mine) & set(want)
        only_mine = [r for r in mine if r not in both][:3]
        only_want = [r for r in want if r not in both][:3]
        problems.append(f"values differ\n   spark {columns} {str(only_mine)[:1500]}\n   sql   {str(only_want)[:1500]}")
    return problems


def main(folder: str, names: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from leadloom.session import build_session

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    queries, oracle, con = entry.queries(), entry.oracle_sql(), connect(folder)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problems = compare(df, con, oracle[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
