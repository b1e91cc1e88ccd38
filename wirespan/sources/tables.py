"""Tables that a job writes to the cluster's shared folder, to cut its lineage and to know their sizes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Written tables of more rows than this are joined by shuffles only.
BROADCAST_ROWS = 100_000

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="wirespan-")
        _folders[app] = f"{top.rstrip('/')}/wirespan-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _folders[app])
    return _folders[app]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone; what is left goes with the shared folder
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def merged_in(df: DataFrame) -> DataFrame:
    """df, which joins shuffle and sort, and never broadcast.

    The optimizer takes the size of compressed files for the size of their rows, which may be fifty times as much: a table
    that it would broadcast as small then fills the driver. The hint holds for what is selected, filtered, grouped or numbered
    of df, but not past a union or a join (where a semi-join, too, is taken to be as small as its left side).
    """
    return df.hint("merge")


def shared_table(df: DataFrame) -> DataFrame:
    """df, computed once: later jobs reread it, also after the loss of executors. It may be broadcast if it has few rows."""
    return counted_table(df)[0]


def counted_table(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """shared_table(df) and aggregates over its rows, which the job that writes them observes as they pass."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in counts.items()]).write.parquet(path)
    found = {name: value or 0 for name, value in seen.get.items()}
    table = spark.read.schema(df.schema).parquet(path)
    return table if found.pop("_rows", 0) <= BROADCAST_ROWS else merged_in(table), found


def drop_tables(df: DataFrame) -> None:
    """Delete the shared tables that df reads and nothing else will."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/wirespan-" in file:
            _delete(df.sparkSession, file)
