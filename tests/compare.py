"""Rows of a Spark query against rows of DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value as both engines give it: numbers as floats to nine digits, containers as tuples, bytes as hex."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    number = float(value)
    return "nan" if math.isnan(number) else float(f"{number:.9g}") + 0.0


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as con:
        for name in TABLES:
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> int:
    (columns, got), (names, wanted) = rows_of(df), rows_of_sql(sql, sf_dir)
    assert columns == names
    missing, extra = wanted - got, got - wanted
    assert not missing and not extra, f"{sum(missing.values())} missing, e.g. {list(missing)[:2]}; {sum(extra.values())} extra, e.g. {list(extra)[:2]}"
    return sum(got.values())
