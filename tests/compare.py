"""Run registered queries next to their SQL: ``python tests/compare.py [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def differences(spark, con, folder, query, sql, limit=3):
    """List of differences; empty when both agree."""
    df = query(spark, folder)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    out = [] if len(left) == len(right) else [f"rows {len(left)} / {len(right)}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    types = {type(v) for r in left for v in r} - {type(v) for r in right for v in r}
    if types - {type(None)} and left:
        out.append(f"types {types}")
    return out + [f"{a} / {b}" for a, b in bad[:limit]]


def main(names):
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    oracles = oracle_sql()
    failed = []
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            found = differences(spark, con, folder, query, oracles[name])
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - began:.1f}s", flush=True)
        for line in found:
            print("    ", line)
        failed += [name] if found else []
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
