"""Run queries beside their SQL twins: ``python tests/oracle_check.py DIR [names]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(kind: str) -> str:
    return kind.replace("large_string", "string")


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} / {sorted(theirs.column_names)}"
    kinds = [
        (n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names
    ]
    wrong = [k for k in kinds if _plain(k[1]) != _plain(k[2])]
    a = Counter(zip(*(ours.column(n).to_pylist() for n in names), strict=True))
    b = Counter(zip(*(theirs.column(n).to_pylist() for n in names), strict=True))
    problems = []
    if wrong:
        problems.append(f"types {wrong}")
    if a != b:
        problems.append(
            f"rows {ours.num_rows} / {theirs.num_rows}, only ours {list((a - b).items())[:2]}, "
            f"only theirs {list((b - a).items())[:2]}"
        )
    return "; ".join(problems)


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                result = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {result} ({time.time() - t:.1f}s)"[:1800], flush=True)


if __name__ == "__main__":
    main()
