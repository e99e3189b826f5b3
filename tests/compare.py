"""Run registered queries on Spark and on DuckDB and compare them value by value.

python tests/compare.py [sf_dir] [name ...]
"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import duckdb  # noqa: E402

from siftline.adapters import TABLES  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def compare(build, sql, spark, con, sf_dir):
    """(status, detail) of one query; equal values must also have equal Python types."""
    frame = build(spark, sf_dir)
    spark_rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return ("rows-only" if spark_rows else "EMPTY"), len(spark_rows)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    other = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return "COLUMNS", (sorted(frame.columns), sorted(names))
    left, right = canonical(frame.columns, spark_rows), canonical(names, other)
    if [list(map(repr, r)) for r in left] == [list(map(repr, r)) for r in right]:
        return ("ok" if left else "EMPTY"), len(left)
    extra, missing = set(left) - set(right), set(right) - set(left)
    return "DIFF", (len(left), len(right), sorted(names), sorted(extra, key=repr)[:2], sorted(missing, key=repr)[:2])


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(sf)
    sqls = entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            status, detail = compare(entry.queries()[name], sqls.get(name), spark, con, sf)
        except Exception as error:  # report and go on
            status, detail = "ERROR", str(error)[:600]
        bad += status not in ("ok", "rows-only")
        print(f"@@ {status:10s} {name:32s} {time.time() - began:6.2f}s {detail}", flush=True)
    print(f"@@ {len(wanted)} queries, {bad} bad")
