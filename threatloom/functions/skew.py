"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join where ``small`` has one row per key and ``big`` may hold most of its rows under one key.

    ``big`` is spread over ``salts`` shares of the key by a hash of the ``spread`` columns and each
    row of ``small`` is copied once per share, so the shuffle never gathers a whole hot key.  The
    copies add ``salts`` rows per key, whatever the size of ``big``.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    right = small.withColumn("_salt", shares)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
