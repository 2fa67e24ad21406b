"""Run registered queries next to their SQL oracles: python -m tests.compare [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    relation = con.sql(sql)
    return relation.columns, [str(t) for t in relation.types], relation.fetchall()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, sf_dir, name):
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    columns, types, want = oracle_rows(sf_dir, entry.oracle_sql()[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    spark_types = {c: t for c, t in df.dtypes}
    same = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in zip(columns, types):
        if same.get(spark_types[c]) != t:
            return f"type of {c}: {spark_types[c]} != {t}"
    a, b = normal(df.columns, got), normal(columns, want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows != {len(b)} rows or values differ: {only}"
    return None if a else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            problem = compare(spark, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
