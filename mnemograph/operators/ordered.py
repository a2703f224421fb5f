"""Ordered scans over the log that never put one key, or the log, in one task.

Each scan has two levels. Rows are cut into blocks of a fixed number of
positions; a window inside (key, block) handles at most one block of rows. The
state entering a block comes from a table with one row per (key, block), which
is small enough for a window per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph import params as P


def _with_block(df: DataFrame, order: str, block: int | None) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(order) / F.lit(block or P.ORDER_BLOCK)))


def carry_forward(df: DataFrame, order: str, value: Column, out: str,
                  keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Latest non-null ``value`` at or before each row (as-of over the order)."""
    part = [*keys, "_blk"]
    src = _with_block(df, order, block).withColumn("_val", value)
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    heads = (
        src.groupBy(*part)
        .agg(F.max_by(F.col("_val"), F.when(F.col("_val").isNotNull(), F.col(order)))
             .alias("_tail"))
        .withColumn("_in", F.last("_tail", ignorenulls=True).over(before))
        .drop("_tail")
    )
    return (
        src.withColumn(out, F.last("_val", ignorenulls=True).over(inside))
        .join(heads, part, "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_in")))
        .drop("_blk", "_val", "_in")
    )


def running_sums(df: DataFrame, order: str, sums: dict[str, Column],
                 keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Inclusive prefix sums per key; ``order`` is unique within a key."""
    part = [*keys, "_blk"]
    src = _with_block(df, order, block)
    for name, expr in sums.items():
        src = src.withColumn(f"_x_{name}", F.coalesce(expr.cast("bigint"), F.lit(0)))
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    heads = src.groupBy(*part).agg(
        *[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    heads = heads.select(
        *part, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_in_{n}")
                 for n in sums])
    res = src.select(
        "*", *[F.sum(f"_x_{n}").over(inside).alias(f"_in_blk_{n}") for n in sums]
    ).join(heads, part, "left")
    for n in sums:
        res = res.withColumn(n, F.col(f"_in_blk_{n}") + F.col(f"_in_{n}"))
        res = res.drop(f"_x_{n}", f"_in_{n}", f"_in_blk_{n}")
    return res.drop("_blk")


def lags(df: DataFrame, order: str, value: str, n: int,
         keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Adds ``lag_1`` … ``lag_n`` of ``value`` within each key."""
    part = [*keys, "_blk"]
    src = _with_block(df, order, block)
    w = Window.partitionBy(*part).orderBy(order)
    src = src.select(
        "*", F.row_number().over(w).alias("_pos"),
        *[F.lag(value, i).over(w).alias(f"_l{i}") for i in range(1, n + 1)])
    # The last n values of a block, newest first; absent ones stay null.
    tails = src.groupBy(*part).agg(*[
        F.max_by(value if i == 1 else f"_l{i - 1}", order).alias(f"_t{i}")
        for i in range(1, n + 1)])
    # n earlier blocks hold at least n earlier values, since none is empty.
    by_key = Window.partitionBy(*keys).orderBy("_blk")
    earlier = [F.lag(f"_t{i}", b).over(by_key)
               for b in range(1, n + 1) for i in range(1, n + 1)]
    heads = tails.select(*part, F.array_compact(F.array(*earlier)).alias("_prev"))
    res = src.join(heads, part, "left")
    for i in range(1, n + 1):
        res = res.withColumn(
            f"lag_{i}",
            F.when(F.col("_pos") > i, F.col(f"_l{i}"))
            .otherwise(F.get("_prev", F.lit(i) - F.col("_pos"))))
    return res.drop("_blk", "_pos", "_prev", *[f"_l{i}" for i in range(1, n + 1)])


def ordinals(df: DataFrame, split_keys: tuple[str, ...], local: str, out: str) -> DataFrame:
    """Dense 1-based positions over (split, place in split) without a global sort.

    ``local`` grows by one from row to row inside a split. Only the per-split
    counts, one row per file split, meet in one window.
    """
    sizes = df.groupBy(*split_keys).agg(F.min(local).alias("_lo"),
                                        F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*split_keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        df.join(offsets, list(split_keys))
        .withColumn(out, F.col("_off") + F.col(local) - F.col("_lo") + 1)
        .drop("_lo", "_n", "_off")
    )
