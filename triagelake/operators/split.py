"""Splits, folds and label shuffles that anyone can recompute.

Order within a class is the md5 of seed and id, so it does not depend on
partitions, and its first two hex digits cut any class into 256 even slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import fixed, text
from triagelake.operators.ranks import md5_slice, sliced_row_number
from triagelake.session import checkpoint

# Ranks of a block of shuffled labels.
BLOCK = 2048


def digest(salt: Column | str | int, key: str) -> Column:
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat_ws("-", salt.cast("string"), F.col(key).cast("string")))


def half_split(df: DataFrame, column: str, min_words: int = fixed.MIN_WORDS_TO_SPLIT) -> DataFrame:
    """First and second half of the words of texts long enough to split."""
    with_words = df.withColumn("_w", text.words(F.col(column)))
    half = F.floor(F.size("_w") / 2).cast("int")
    return (
        with_words.where(F.size("_w") >= min_words)
        .withColumns(
            {
                "query_half": F.array_join(F.slice("_w", F.lit(1), half), " "),
                "document_half": F.array_join(
                    F.slice("_w", half + 1, F.size("_w") - half), " "
                ),
            }
        )
        .drop("_w")
    )


def ranked_in_class(
    df: DataFrame, label: str, key: str, salt, extra: list[str] | None = None
) -> DataFrame:
    """Add ``rn`` and ``class_rows`` per class in digest order."""
    hashed = df.withColumn("_digest", digest(salt, key))
    ranked = sliced_row_number(
        hashed,
        [*(extra or []), label],
        md5_slice(F.col("_digest")),
        [F.col("_digest"), F.col(key)],
        rank="rn",
        total="class_rows",
    )
    return ranked.drop("_digest")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``is_test``: ``round(test_size * n)`` rows of every class."""
    rows = df.where(F.col(label).isNotNull())
    ranked = ranked_in_class(rows, label, key, seed)
    share = F.round(F.lit(test_size) * F.col("class_rows")).cast("long")
    quota = F.when(F.col("class_rows") >= 2, F.greatest(share, F.lit(1))).otherwise(share)
    return ranked.withColumn("is_test", F.col("rn") <= quota).drop("rn", "class_rows")


def folds(
    df: DataFrame,
    label: str,
    key: str,
    n_splits: int = fixed.N_SPLITS,
    n_repeats: int = fixed.N_REPEATS,
    seed: int = fixed.SEED,
) -> DataFrame:
    """One row per repeat and input row with its stratified ``fold``."""
    rows = df.where(F.col(label).isNotNull())
    repeats = F.explode(F.array(*[F.lit(r) for r in range(n_repeats)]))
    repeated = rows.select("*", repeats.alias("repeat"))
    salt = F.concat_ws("-", F.lit(str(seed)), F.col("repeat").cast("string"))
    ranked = ranked_in_class(repeated, label, key, salt, extra=["repeat"])
    return ranked.withColumn(
        "fold", ((F.col("rn") - 1) % n_splits).cast("int")
    ).drop("rn", "class_rows")


def holdout(df: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Rows not in the test set."""
    return df.join(test.select(key), key, "left_anti")


def ranked_by_digest(df: DataFrame, label: str, key: str, seed: int = fixed.SEED) -> DataFrame:
    """``(key, label, _rank)`` of labelled rows: their place in digest order, from 1."""
    rows = df.where(F.col(label).isNotNull()).select(key, label)
    hashed = rows.withColumn("_digest", digest(seed, key)).withColumn("_all", F.lit(0))
    ranked = sliced_row_number(
        hashed, ["_all"], md5_slice(F.col("_digest")), [F.col("_digest"), F.col(key)], rank="_rank"
    )
    return ranked.select(key, label, "_rank")


def _pieces(batches) -> Iterator[pa.RecordBatch]:
    """Lists of labels that follow each other, from rows sorted by permutation and digest."""
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        perm, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero(np.r_[True, (perm[1:] != perm[:-1]) | (part[1:] != part[:-1])])
        ends = pa.array(np.append(edge, batch.num_rows).astype(np.int32))
        numbers = pa.array(np.arange(number, number + len(edge)))
        labels = pa.ListArray.from_arrays(ends, batch.column(2))
        yield pa.record_batch([pa.array(perm[edge]), pa.array(part[edge]), numbers, labels], names=["perm", "part", "number", "labels"])
        number += len(edge)


def shuffled_blocks(
    df: DataFrame,
    label: str,
    key: str,
    permutations: int = fixed.N_PERMUTATIONS,
    seed: int = fixed.SEED,
) -> DataFrame:
    """``(perm, block, at, labels)``: the labels that the rows of ranks ``block * BLOCK + at + 1``
    and on take.  Each permutation has its own digest order, in which every row is
    sorted once; from there labels travel as lists.
    """
    rows = df.where(F.col(label).isNotNull()).select(label, key)
    perms = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    salt = F.concat_ws("-", F.lit(str(seed)), F.col("perm").cast("string"))
    salted = rows.select(label, key, perms).withColumn("_digest", F.unhex(digest(salt, key)))
    part = F.conv(F.hex(F.substring("_digest", 1, 1)), 16, 10).cast("int")
    salted = salted.select("perm", part.alias("part"), F.col(label).alias("label"), "_digest", key)
    order = salted.repartition("perm", "part").sortWithinPartitions("perm", "_digest", key)
    kind = T.StructType([
        T.StructField("perm", T.IntegerType()), T.StructField("part", T.IntegerType()),
        T.StructField("number", T.LongType()), T.StructField("labels", T.ArrayType(rows.schema[label].dataType)),
    ])
    pieces = checkpoint(order.select("perm", "part", "label").mapInArrow(_pieces, kind))
    line = Window.partitionBy("perm").orderBy("part", "number")
    before = F.sum(F.size("labels")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("perm", "part", "number", F.coalesce(before, F.lit(0)).alias("start"))
    placed = pieces.join(starts, ["perm", "part", "number"]).withColumn("end", F.col("start") + F.size("labels"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (end - 1) div {BLOCK})")))
    first = F.greatest("start", F.col("block") * BLOCK)
    n = F.least("end", (F.col("block") + 1) * BLOCK) - first
    inside = F.slice("labels", (first - F.col("start") + 1).cast("int"), n.cast("int"))
    return cut.select("perm", "block", (first - F.col("block") * BLOCK).cast("int").alias("at"), inside.alias("labels"))


def shuffled_labels(
    df: DataFrame,
    label: str,
    key: str,
    permutations: int = fixed.N_PERMUTATIONS,
    seed: int = fixed.SEED,
) -> DataFrame:
    """``(perm, key, label)``: every permutation keeps the label counts.

    The row with base rank r takes the label of the row that has rank r in
    the permutation's own digest order.
    """
    base = ranked_by_digest(df, label, key, seed).select(key, "_rank")
    blocks = shuffled_blocks(df, label, key, permutations, seed)
    drawn = blocks.select("perm", "block", "at", F.posexplode("labels").alias("_pos", label))
    drawn = drawn.withColumn("_rank", F.col("block") * BLOCK + F.col("at") + F.col("_pos") + 1)
    # Drawn rows outnumber the planner's guess, so they are never broadcast.
    return drawn.join(base.hint("merge"), "_rank").select("perm", key, label)
