"""Run queries and their DuckDB twins on one folder of tables and compare the rows."""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(
                f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'"
            )
    return con


def cell(value):
    """Values compared exactly, but for the type names the two engines give them."""
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def kinds(df) -> dict[str, str]:
    names = {"timestamp_ntz": "timestamp", "int": "integer", "string": "varchar"}
    return {c: names.get(k, k) for c, k in df.dtypes}


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when schema and rows agree, else what differs."""
    df = entry_points.queries()[name](spark, sf_dir)
    result = con.execute(entry_points.oracle_sql()[name])
    described = {d[0]: str(d[1]).lower() for d in result.description}
    if kinds(df) != described:
        return f"schema {kinds(df)} != {described}"
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(list(described), result.fetchall())
    if ours != theirs:
        return (
            f"{sum(ours.values())} against {sum(theirs.values())} rows; only here"
            f" {list((ours - theirs).items())[:3]}; only there"
            f" {list((theirs - ours).items())[:3]}"
        )
    return None


if __name__ == "__main__":
    from ledgerlane.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry_points.queries())
    session = local_session("compare")
    connection = duck(folder)
    failed = 0
    for query in wanted:
        start = time.time()
        found = difference(session, connection, folder, query)
        failed += found is not None
        print(f"{'FAIL' if found else 'ok':5}{time.time() - start:6.2f}s {query} {found or ''}")
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
