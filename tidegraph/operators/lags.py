"""Sums of products of a trace's values at each lag, by blocks of consecutive iterations.

A block is sent its own rows and those up to the largest lag before it, so a row goes to one block, or to two near an edge,
however many lags there are; a block gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Iterations of a block; as many as the largest lag where that is more.
BLOCK = 1 << 14


def dealt(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, order, block, own (whether the block is the row's), iter, x; no null iterations, a null x is 0."""
    width = F.greatest(F.lit(block), "order")
    of = lambda i: F.floor(i / width)
    at = F.col("iter")
    placed = rows.where("iter IS NOT NULL").withColumn("block", F.explode(F.sequence(of(at), of(at + F.col("order")))))
    return placed.select(*keys, "order", "block", (F.col("block") == of(at)).alias("own"), at.cast("long").alias("iter"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))


def _multiplied(keys: list[str]):
    def f(table: pa.Table) -> pa.Table:
        order = table.column("order")[0].as_py()
        at, x, own = (table.column(c).to_numpy() for c in ("iter", "x", "own"))
        at = at - at.min()
        own = own.astype(bool)
        n = int(at.max()) + 1
        near, late = np.bincount(at, x, n), np.bincount(at[own], x[own], n)
        some, some_late = np.bincount(at, minlength=n).astype(float), np.bincount(at[own], minlength=n).astype(float)
        sums = [float(late[k:] @ near[: n - k]) if k < n else 0.0 for k in range(order + 1)]
        pairs = [int(some_late[k:] @ some[: n - k]) if k < n else 0 for k in range(order + 1)]
        out = table.select(keys).slice(0, 1)
        return out.append_column("sums", pa.array([sums], pa.list_(pa.float64()))).append_column("pairs", pa.array([pairs], pa.list_(pa.int64())))

    return f


def lag_sums(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, lag, ss, pairs: sums and numbers of products x(iter) x(iter - lag), at lags 0 to order.

    rows: keys, iter, x, order; order is the same in all rows of a trace.
    """
    blocks = dealt(rows, keys, block)
    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("pairs", T.ArrayType(T.LongType()))])
    each = blocks.groupBy(*keys, "block").applyInArrow(_multiplied(keys), schema)
    lags = each.select(*keys, F.posexplode(F.arrays_zip("sums", "pairs")).alias("lag", "of"))
    return lags.groupBy(*keys, "lag").agg(F.sum("of.sums").alias("ss"), F.sum("of.pairs").alias("pairs"))
