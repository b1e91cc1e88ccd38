"""Bloom filters of a bounded size, built and asked in DataFrame functions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import materialised

#: A filter is never larger than this; with more keys it errs more often, which costs work and no result.
MAX_BYTES = 16 << 20


class Bloom:
    """A filter of the values in ``keys``' column key: m bits, of which k belong to a key by double hashing.

    A bigint key is taken for a hash already, so that asking for it reads the hashed text once or twice.
    """

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int = 0, max_bytes: float = MAX_BYTES):
        bits = min(max(n, 1) * -math.log(rate) / math.log(2) ** 2, 8 * max_bytes)
        self.hashed = keys.schema["key"].dataType.simpleString() == "bigint"
        self.seed, self.m = seed, 64 * max(1, math.ceil(bits / 64))
        self.k = min(24, max(1, round(self.m / max(n, 1) * math.log(2))))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        words = keys.select(F.explode(F.array(*[self._place(F.col("key"), F.lit(i)) for i in range(self.k)])).alias("at")).select(F.shiftright("at", 6).alias("w"), one.alias("bits"))
        self.words = words.groupBy("w").agg(F.bit_or("bits").alias("bits"))

    def _place(self, key: Column, i: Column) -> Column:
        first, step = (key, F.xxhash64(key, F.lit(self.seed))) if self.hashed else (F.xxhash64(F.lit(2 * self.seed), key), F.xxhash64(F.lit(2 * self.seed + 1), key))
        return F.pmod(F.shiftright(first, 8) + i * F.shiftright(step, 8), F.lit(self.m))

    def table(self) -> DataFrame:
        """The filter as one row in the shared folder, an array of 64-bit words."""
        every = self.words.sparkSession.range(self.m // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
        full = self.words.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
        return materialised(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words")))

    def filtered(self, rows: DataFrame, key: Column, inside: bool = True) -> DataFrame:
        """Rows whose key may be in the filter (or is not in it), which every task gets as a scalar subquery's value."""
        words = self.table().scalar()
        bit = lambda at: F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        has = reduce(Column.__and__, [bit(self._place(key, F.lit(i))) for i in range(self.k)])
        return rows.where(has if inside else ~has)

    def constant(self) -> Column:
        """The filter as a binary constant of seven bits a byte, which unlike a subquery lambdas may ask."""
        words = np.zeros(self.m // 64, np.int64)
        for r in self.words.collect():  # at most m / 64 rows
            words[r.w] = r.bits
        bits = np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 7, np.uint8)]).reshape(-1, 7)
        return F.lit(bytearray(np.packbits(bits, axis=1, bitorder="little").tobytes()))

    def has(self, constant: Column, key: Column) -> Column:
        """Whether the key may be in the filter, given as a constant."""
        byte = lambda at: F.ascii(F.substring(constant, F.expr("1") + (at / 7).cast("int"), F.lit(1)).cast("string"))
        bit = lambda at: F.call_function("shiftright", byte(at), (at % 7).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.forall(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: bit(self._place(key, i.cast("long"))))


def suspects(keys: DataFrame) -> Bloom:
    """A filter of the texts, by their hashes in the column key, that a later step works on."""
    keys = materialised(keys.distinct())
    return Bloom(keys, keys.count(), 0.01)
