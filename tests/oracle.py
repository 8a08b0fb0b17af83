"""Compare named queries with their SQL. Run as a script: `python tests/oracle.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "SMALLINT": "smallint",
         "DATE": "date"}


def make_spark(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("clickloom")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(rows, order):
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, text: str) -> tuple[list[str], int]:
    """(problems, rows)"""
    got = [tuple(r) for r in df.collect()]
    found = con.execute(text)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {text}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"], len(got)
    problems = [
        f"type of {c}: {t} / {types[c]}" for c, t in df.dtypes if TYPES.get(types[c], types[c]) != t
    ]
    a = _rows(got, [df.columns.index(c) for c in sorted(names)])
    b = _rows(want, [names.index(c) for c in sorted(names)])
    if len(a) != len(b):
        problems.append(f"rows {len(a)} / {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return problems, len(a)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, oracle = make_spark(), connect(sf_dir), oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracle:
                problems, rows = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                problems, rows = [], len(fn(spark, sf_dir).collect())
            note = "" if name in oracle else " (rows only)"
        except Exception as e:  # noqa: BLE001
            problems, rows, note = [f"{type(e).__name__}: {str(e)[:600]}"], -1, ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} {time.time() - start:.1f}s{note} {' ; '.join(problems)}", flush=True)
    print(f"{failed} failed of {len(wanted) or len(queries())}, {len(oracle)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
