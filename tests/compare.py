"""Runs registered queries beside their oracles: same columns, same types, same rows.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.registry import TABLES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def difference(frame: DataFrame, con: duckdb.DuckDBPyConnection, oracle: str) -> str | None:
    """What differs, or None."""
    ours = dict(sorted(frame.dtypes))
    described = con.execute(f"DESCRIBE {oracle}").fetchall()
    theirs = dict(sorted((r[0], r[1]) for r in described))
    if {c: KINDS.get(k, k) for c, k in ours.items()} != theirs:
        return f"columns: {ours} against {theirs}"
    names = list(ours)
    left = Counter(tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    right = Counter(con.execute(f"SELECT {quoted} FROM ({oracle})").fetchall())
    if left == right:
        return None
    only_left, only_right = list((left - right).items()), list((right - left).items())
    return (
        f"rows: {sum(left.values())} against {sum(right.values())}; {len(only_left)} only in Spark, {len(only_right)} only "
        f"in the oracle\n  {names}\n  Spark  {sorted(map(str, only_left))[:3]}\n  oracle {sorted(map(str, only_right))[:3]}"
    )


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from tidemark.plans import catalog

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(catalog.QUERIES)
    spark, con, bad = session(), connect(folder), 0
    for name in chosen:
        start = time.time()
        try:
            frame = catalog.QUERIES[name](spark, folder)
            if name in catalog.ORACLES:
                found = difference(frame, con, catalog.ORACLES[name])
                rows = con.execute(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchall()[0][0]
            else:
                found, rows = "no oracle", frame.count()
        except Exception as e:  # noqa: BLE001
            found, rows = f"{type(e).__name__}: {str(e)[:600]}", "?"
        bad += bool(found) and not str(found).startswith("no oracle")
        print(f"{name:32s} {time.time() - start:6.2f}s {rows} rows {found or 'equal'}", flush=True)
    print(f"{len(chosen)} queries, {bad} differ")


if __name__ == "__main__":
    main()
