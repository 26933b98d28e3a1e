"""A bit table of fixed bounds that lets rows pass which a later join can't concern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 bits for each wanted key, within these bounds (2 MB at most are broadcast). With more keys more rows are let in; none is lost.
FILTER_BITS = (1 << 20, 1 << 24)


class Sieve:
    """Bit table over the values of wanted.key (long). `mask` is true for all of them, and for few other values."""

    def __init__(self, wanted: DataFrame, key: str):
        keys = wanted.select(F.col(key).alias("k")).where("k is not null")
        self.bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * max(1, keys.count())).bit_length()))
        at = F.pmod(F.col("k"), F.lit(self.bits))
        words = np.zeros(self.bits // 64, dtype=np.uint64)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
        found = keys.select(at.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
        if found.num_rows:
            words[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
        self.table = wanted.sparkSession.sparkContext.broadcast(words)

    def mask(self, k: np.ndarray) -> np.ndarray:
        p = np.mod(k, self.bits)
        return ((self.table.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)) > 0


def perhaps(wanted: DataFrame, key: str) -> Column:
    """Condition on the long column `key`: true for all values of wanted.key, and for few others."""
    sieve = Sieve(wanted, key)
    return F.arrow_udf(lambda k: pa.array(sieve.mask(k.to_numpy(zero_copy_only=False))), "boolean")(F.col(key))
