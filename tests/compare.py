"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, entry, sf_dir: str, name: str) -> str:
    """'' if equal, else what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no SQL; {len(got)} rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"DIFFERENT columns {df.columns} {names}"
    a, b = canonical(got, df.columns), canonical(want, names)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"DIFFERENT {len(a)} {len(b)} only Spark {x} only SQL {y}"
    return "" if got else "EMPTY"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            said = compare(spark, entry, sys.argv[1], name)
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:600]
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
