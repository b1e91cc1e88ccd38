"""Whitening of embeddings by the singular values of their centred rows.

An entry c becomes the whole number x = floor(1024 c) + 100000. Their number n
and their sums S by dimension are exact; rows x - S/n go as a distributed
RowMatrix to MLlib's computeSVD, whose singular values s give the covariance's
eigenvalues e = s^2 / n and whose right vectors are its eigenvectors. The total
variance does not come from there: it is the exact sum of all deviations
(n x - S)^2, divided by n^3. All singular vectors are asked for up to FULL
dimensions, which takes LAPACK's full double precision; beyond, the first ones.

What reaches the driver are d sums and d x COMPONENTS loadings (d x d up to
FULL), whatever the number of rows; the Gram matrix is summed up over a tree
of executors.

Rows are dropped if their vector is null or empty, holds a null, NaN or infinite
entry, or one whose x no long can hold, or has another length than most vectors
have (ties: the longest). Repeated rows and ids each count, null ids are a
value, further columns are ignored. Without variance there are no components
and no rows, nor are there components beyond the matrix's rank. ``deviation``
is null where a long cannot hold it; ``deviation_exact`` goes on to 38 digits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import materialised, read

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Up to so many dimensions all singular vectors are computed.
FULL = 2048
#: Singular values below this share of the first are rounding errors of the Gram matrix, whose entries are their squares.
RANK = 2e-7
SCHEMA = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x of rows whose vector has at least one entry and none that is null, not finite or too large."""
    fits = f"forall(e, c -> c is not null and abs({SCALE}D * c) < 9.2e18D)"  # NaN is larger than any number
    found = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where(f"size(e) > 0 and {fits}")
    return found.selectExpr("vec_id", f"transform(e, c -> cast(floor({SCALE}D * c) as bigint) + {SHIFT}L) as x")


def loadings(centred: DataFrame, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (d x k) of the covariance of an array column; the largest entry of each is positive."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("y").alias("y")), "y")
    svd = RowMatrix(vectors, numCols=d).computeSVD(d if d <= FULL else min(COMPONENTS, d), computeU=False, rCond=RANK)
    values = svd.s.toArray()[:COMPONENTS] ** 2 / n
    v = svd.V.toArray()[:, : len(values)]
    return values, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(values))])


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component (from 1, by falling eigenvalue): see SCHEMA and the module."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    x = materialised(whole_numbers(rows, id_col, vec_col))
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], SCHEMA.format(kind=kind))
    d, n = most.d, most.n
    x = x.where(F.size("x") == d)
    sums = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect()
    total = [int(s) for _, s in sorted((r.i, r.s) for r in sums)]
    # Longs hold every step where the widest deviation's square does; decimals hold the rest. Both are exact.
    if d * (n * (most.high - most.low)) ** 2 < 1 << 63 and n * max(abs(most.low), abs(most.high)) < 1 << 62:
        deviation = f"cast(aggregate(zip_with(x, s, (c, t) -> ({n}L * c - t) * ({n}L * c - t)), 0L, (a, b) -> a + b) as decimal(38,0))"
        s = F.lit(total).cast("array<bigint>")
    else:
        apart = f"try_subtract(try_multiply(cast({n} as decimal(20,0)), cast(c as decimal(20,0))), t)"
        deviation = f"aggregate(transform(zip_with(x, s, (c, t) -> {apart}), v -> try_multiply(v, v)), cast(0 as decimal(38,0)), (a, b) -> cast(try_add(a, b) as decimal(38,0)))"
        s = F.array(*[F.lit(str(t)).cast("decimal(38,0)") for t in total])
    deviated = x.withColumn("s", s).selectExpr("vec_id", "x", f"{deviation} as deviation_exact")
    means = F.lit([t / n for t in total]).cast("array<double>")
    both = materialised(deviated.withColumn("y", F.zip_with("x", means, lambda c, m: c - m)).select("vec_id", "deviation_exact", "y"))
    # Rounded only here: halves are summed apart, as a sum of 38 digits may need more.
    half = "try_divide(deviation_exact, cast(1000000000000 as decimal(38,0)))"
    deviations = both.selectExpr("sum(cast(deviation_exact % 1000000000000 as decimal(38,0))) as low", f"sum(cast(floor({half}) as decimal(38,0))) as high", "count_if(deviation_exact is null) as lost").first()
    if deviations.lost:  # entries near the ends of a long: the rows' own squares
        variance = math.fsum(both.select(F.sum(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v))).first()) / n
    else:
        variance = (int(deviations.low) + int(deviations.high) * 10**12) / n**3
    if not variance:
        return spark.createDataFrame([], SCHEMA.format(kind=kind))
    values, v = loadings(both, d, n)
    matrix = spark.sparkContext.broadcast(v / np.sqrt(values))  # d x COMPONENTS

    def projected(batches):
        for batch in batches:
            y = batch.column(2)
            flat = y.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d) @ matrix.value
            k = flat.shape[1]
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * k + 1, k), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["vec_id", "deviation_exact", "w"])

    white = materialised(both.mapInArrow(projected, f"vec_id {kind}, deviation_exact decimal(38,0), w array<double>"))
    k = len(values)
    centre = list(white.select(*[F.avg(F.col("w")[i]) for i in range(k)]).first())
    apart = [F.col("w")[i] - F.lit(centre[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = white.select(*[F.avg(apart[i] * apart[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    explained = F.lit([float(e / variance) for e in values])
    out = white.select("vec_id", "deviation_exact", F.posexplode("w").alias("i", "whitened"))
    return out.select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation_exact as bigint)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
        "deviation_exact",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
