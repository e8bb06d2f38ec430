"""Joins with one row a key where some keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: A key with more than this part of the rows is hot; so there are at most its inverse of them.
HOT_SHARE = 1 / 1_000
SALTS = 256


def join_per_key(df: DataFrame, per: DataFrame, key: str, size: str, values: Sequence[str], inner: bool = False) -> DataFrame:
    """``df`` with the columns ``values`` of the one row that ``per`` has for its key; NULLs where it has none.

    ``size``: a column of ``per``, how many rows of ``df`` have the key.  The
    rows of the hot keys, of which there are at most a thousand, are joined by
    broadcast; they and the rows without a key are dealt out by a hash of the
    whole row, so no task of the join holds a hot key.  ``inner`` drops the
    rows whose key is NULL or not in ``per``.
    """
    per = materialize(per.where(F.col(key).isNotNull()).select(F.col(key).alias("k__"), F.col(size).alias("n__"), *(F.col(v).alias(f"v{i}__") for i, v in enumerate(values))), "per_key")
    least = (per.agg(F.sum("n__")).first()[0] or 0) * HOT_SHARE
    names = [f"v{i}__" for i in range(len(values))]
    left = df.drop(*values)
    if inner:
        left = left.where(F.col(key).isNotNull())
    hot = per.where(F.col("n__") > least).select(F.col("k__").alias("h__"), F.struct(*names).alias("hot__"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("h__"), "left").drop("h__")  # at most 1,000 rows
    aside = F.col("hot__").isNotNull() | F.col(key).isNull()
    salt = F.when(aside, 1 + F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0)
    # always 0, but no literal: the optimizer would fold that and join by the bare key
    zero = F.pmod(F.xxhash64("k__"), F.lit(1)).cast("bigint")
    cold = per.where(F.col("n__") <= least).withColumns({"c__": zero, "seen__": F.lit(True)})
    out = marked.withColumn("s__", salt.cast("bigint")).join(cold, (F.col(key) == F.col("k__")) & (F.col("s__") == F.col("c__")), "left")
    if inner:
        out = out.where("hot__ IS NOT NULL OR seen__")
    return out.select(*left.columns, *(F.coalesce(F.col(f"hot__.{n}"), F.col(n)).alias(v) for n, v in zip(names, values, strict=True)))
