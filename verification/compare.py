"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from verification import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return int(value)
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """What differs between the two sides of a query of the catalog, or None."""
    return difference_of(spark, connection, sf_dir, catalog.REGISTRY[name], oracle.oracle_sql().get(name))


def difference_of(
    spark: SparkSession, connection: duckdb.DuckDBPyConnection, sf_dir: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None
) -> str | None:
    """What differs between a query and its SQL, or None; a query without SQL must give rows."""
    result = query(spark, sf_dir)
    got = result.collect()
    if sql is None:
        return None if got else "no rows"
    cursor = connection.execute(sql)
    columns = [column[0] for column in cursor.description]
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(columns)}"
    ours, theirs = _rows(result.columns, got), _rows(columns, cursor.fetchall())
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{ours.total()} rows against {theirs.total()}; {extra.total()} extra such as {str(next(iter(extra), None))[:300]}; "
        f"{missing.total()} missing such as {str(next(iter(missing), None))[:300]}"
    )
