"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that is the beginning of a longer one is dropped; of
equal conversations the one with the smallest id stays.  Every turn carries a
rolling hash of the turns up to it (128 bits); anti-joins of whole-conversation
hashes against hashes of proper beginnings keep the maximal conversations,
which alone have their texts moved and rendered.

Defined results: turns are ordered by number, then by role and text, NULL
numbers first, for hashes and rendering alike; NULL role or text equals the
empty string; rows with NULL conversation id form one conversation; a repeated row is a turn of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, n`` and the hashes ``h1, h2`` of the first ``n`` turns."""
    hashed = turns.select(
        "conv_id", "turn",
        F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"),
        "role", "text",
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = hashed.select("conv_id", "a", "b", F.row_number().over(order).alias("n"))
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rolled = [
        F.bit_xor(F.xxhash64(F.lit(s), "n", c)).over(so_far).alias(h)
        for s, c, h in ((5, "a", "h1"), (6, "b", "h2"))
    ]
    last = F.max("n").over(Window.partitionBy("conv_id"))
    return numbered.select("conv_id", "n", *rolled, (F.col("n") == last).alias("whole"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations to keep."""
    rolled = prefix_hashes(turns)
    wholes = rolled.where("whole").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    begun = rolled.where(~F.col("whole")).select("n", "h1", "h2").distinct()
    return wholes.join(begun, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, chat``."""
    turns = turns.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    kept = maximal(turns).withColumnRenamed("conv_id", "_id")
    told = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    gathered = told.groupBy("conv_id", "n_turns").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    one = lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n"))
    return gathered.select(
        "conv_id", F.col("n_turns").cast("long"), F.array_join(F.transform("turns", one), "").alias("chat")
    )
