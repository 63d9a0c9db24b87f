"""Ranks and exact quantiles that never put one whole key into one task.

A plain ``row_number`` sorts each key in a single task, which fails when one
key holds a large part of the table.  Here every key is cut into slices that
follow the sort order; a small table of slice sizes supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def md5_slice(digest: Column) -> Column:
    """Slice of a hex digest: its first two characters, 256 even slices."""
    return F.substring(digest, 1, 2)


def range_slice(df: DataFrame, value: Column, pieces: int = SLICES) -> Column:
    """Slice number of a numeric value, NULLs last.

    The boundaries are approximate quantiles of the whole table, read once
    and then fixed in the plan, so a recomputed task sees the same slices.
    """
    probs = [i / pieces for i in range(1, pieces)]
    bounds = df.agg(F.percentile_approx(value, probs, 10_000).alias("b")).first().b
    distinct = sorted(set(bounds or []))
    below = F.filter(F.array(*[F.lit(b) for b in distinct]), lambda b: b <= value)
    if not distinct:
        return F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0))
    return F.when(value.isNull(), F.lit(len(distinct) + 1)).otherwise(F.size(below))


def sliced_row_number(
    df: DataFrame,
    keys: list[str],
    slice_by: Column,
    order: list[Column],
    rank: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based row number within ``keys``, and the key's row count.

    ``slice_by`` must not be NULL and must rise with ``order``.
    """
    sliced = df.withColumn("_slice", slice_by)
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    ranked = sliced.join(offsets, [*keys, "_slice"]).withColumn(
        rank, F.col("_offset") + inside
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_slice", "_offset", "_total")


def quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles as one row, one column per name.

    ``percentile`` keeps every distinct value in one buffer.  This counts
    values first and accumulates the counts slice by slice instead.
    """
    values = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        F.col(value).cast("double").alias("v")
    )
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    sliced = counts.withColumn("_slice", range_slice(values, F.col("v")))
    # One row per slice: bounded by the number of slices.
    whole = Window.orderBy("_slice")
    sizes = sliced.groupBy("_slice").agg(F.sum("n").alias("m"))
    offsets = sizes.select(
        "_slice",
        (F.sum("m").over(whole) - F.col("m")).alias("_offset"),
        F.sum("m").over(
            whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("_total"),
    )
    inside = F.sum("n").over(Window.partitionBy("_slice").orderBy("v"))
    placed = sliced.join(F.broadcast(offsets), "_slice").select(
        "v", (F.col("_offset") + inside).alias("hi"), "n", F.col("_total").alias("total")
    )

    def at(position: Column) -> Column:
        here = (position >= F.col("hi") - F.col("n")) & (position < F.col("hi"))
        return F.max(F.when(here, F.col("v")))

    out = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        share = F.max(position - F.floor(position))
        out.append((low + (high - low) * share).alias(name))
    return placed.agg(*out)
