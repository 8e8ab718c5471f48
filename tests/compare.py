"""Compares queries with their SQL the way the driver does: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v: object) -> object:
        if isinstance(v, float):
            return f"{v:.9g}" if v == v else "nan"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, name: str, query, sql: str) -> list[str]:
    import duckdb

    got = query(spark, sf_dir)
    left = rows_of(got.columns, [tuple(r) for r in got.collect()])
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("SET TimeZone='UTC'")
    want = con.sql(sql)
    right = rows_of(want.columns, want.fetchall())
    out = []
    if sorted(got.columns) != sorted(want.columns):
        out.append(f"columns {sorted(got.columns)} / {sorted(want.columns)}")
    if len(left) != len(right):
        out.append(f"{len(left)} / {len(right)} rows")
    bad = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out


def main() -> None:
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            out = differences(spark, sys.argv[1], name, queries[name], sql[name]) if name in sql else [f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"]
        except Exception as x:  # noqa: BLE001  shown, and the next one runs
            out = ["ERROR " + " | ".join(str(x).splitlines()[:6])[:900]]
        print(f"{name}: {'; '.join(out) or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
