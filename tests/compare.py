"""Run queries beside their SQL on DuckDB: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple("" if v is None else str(v) for v in row) for row in rows))


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """What differs, or an empty string."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    got = normal([tuple(r) for r in found.select(*columns).collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    want = normal([tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()])
    if got == want:
        return ""
    extra, lost = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only here {extra}, only in SQL {lost}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sql, bad = e.oracle_sql(), 0
    for name, query in e.queries().items():
        if names and name not in names or not names and name.startswith(("op", "pipeline")):
            continue
        began = time.time()
        try:
            said = compare(spark, sf_dir, name, query, sql[name]) if name in sql else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
