"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.sources.tables import shared_table

#: ASCII white space, as a class body for regular expressions.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that later jobs and lost executors reread it."""
    return shared_table(df)


def crc_mod(id_column: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Tasks that a group with more than its share of the rows is dealt over.
SALTS = 16
#: A group is heavy from one row in so many on, so there are never more heavy groups than this.
SHARE = 1024


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, deal_by: str, how: str = "inner") -> DataFrame:
    """rows joined with their groups (a written table of one row for each ``keys``, whose ``count`` is how many rows it has).

    Only heavy groups are salted. They are fewer than SHARE, as each has more than one row in SHARE, so the list of them
    that is broadcast has a proven bound.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(1000, total // SHARE)
    heavy = groups.where(F.col(count) > least).select(*keys, F.lit(True).alias("_heavy"))
    if not heavy.limit(1).count():
        return rows.join(groups, keys, how)
    salt = F.when(F.col("_heavy"), F.pmod(F.hash(deal_by), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_heavy")
    salts = F.explode(F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(groups.withColumn("_salt", salts), [*keys, "_salt"], how).drop("_salt")
