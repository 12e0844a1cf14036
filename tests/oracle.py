"""Compare registered queries with their check SQL on DuckDB.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return "0.0"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    """Rows as text with the columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_frame, connection, sql):
    """``(equal, message)``"""
    columns = spark_frame.columns
    ours = rows_of(columns, [tuple(row) for row in spark_frame.collect()])
    result = connection.execute(sql)
    names = [entry[0] for entry in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} / {sorted(names)}"
    if ours != theirs:
        wrong = [pair for pair in zip(ours, theirs) if pair[0] != pair[1]][:2]
        return False, f"{len(ours)} / {len(theirs)} rows, first differences {wrong}"
    return True, f"{len(ours)} rows"


def main(arguments):
    import __spark_entry__ as entry_module
    from predlens.session import build_session

    scale = arguments[0] if arguments else "0.01"
    folder = f"{DATA}/sf{scale}"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    failed = 0
    wanted = arguments[1:] or list(queries)
    if wanted[0].startswith("family:"):
        ending = "." + wanted[0].partition(":")[2]
        wanted = [name for name in queries if queries[name].__module__.endswith(ending)]
    for name in wanted:
        start = time.time()
        try:
            if name in checks:
                good, message = compare(queries[name](spark, folder), connection, checks[name])
            else:
                good, message = True, f"{len(queries[name](spark, folder).collect())} rows (no SQL)"
        except Exception as error:  # report and go on with the next query
            good, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:22s} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
