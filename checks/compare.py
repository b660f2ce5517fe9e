"""Run registered queries beside their SQL and report differences: python -m checks.compare SF_DIR [key ...]"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("listwarden")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


# type names of the SQL engine for each Spark type
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def compare(spark, con, key: str, sf_dir: str, queries, oracles) -> str:
    """Empty text when equal, else what differs."""
    df = queries[key](spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    result = con.execute(oracles[key])
    columns = [c[0] for c in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = dict(zip(columns, [str(c[1]) for c in result.description]))
    wrong = [(c, t, kinds[c]) for c, t in df.dtypes if SAME.get(t) != kinds[c]]
    if wrong:
        return f"types {wrong}"
    if mine != theirs:
        only_mine, only_theirs = mine - theirs, theirs - mine
        return (
            f"rows {mine.total()} / {theirs.total()}; {only_mine.total()} only here, e.g. {list(only_mine)[:2]}; "
            f"{only_theirs.total()} only there, e.g. {list(only_theirs)[:2]}"
        )
    return "" if mine else "no rows"


def main() -> int:
    from checks.catalog import QUERIES
    from checks.oracles import ORACLES

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), database(sf_dir), 0
    for key in keys:
        if key not in ORACLES:
            print(f"{key:26s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, key, sf_dir, QUERIES, ORACLES)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += bool(problem)
        print(f"{key:26s} {'ok' if not problem else 'DIFFERS ' + problem[:900]} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} of {len(keys)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
