"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters every record by seeded hashes: the highest of one hash per
shard picks the shard, so that one more shard takes rows only into itself,
and a second hash picks one of the shard's memory-sized buckets.  Pass two
shuffles each bucket by Fisher-Yates and writes it.  The buckets of a shard
follow one another, so slots are the bucket's offset plus the place in it.

Defined results: a NULL key is a key like any other; NULL text counts no
bytes; rows that repeat a key all go to its shard; an empty table gives empty
shards; columns named like the added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.names import fresh
from triagelake.session import checkpoint

BUCKET_BYTES = 16 << 20
ROW_BYTES = 16
ADDED = ("shard", "grown_shard", "bucket", "place", "slot")


def pick_shard(key: str, seed: int, shards: int):
    """Struct ``(shard, grown_shard)`` of a key, for ``shards`` and one more."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    null = F.col(key).isNull()
    bids = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(i), null, name).alias("bid"), F.lit(i).alias("to"))
        for i in range(shards + 1)
    ]
    best = F.array_max(F.array(*bids[:-1]))
    return F.struct(best["to"].alias("shard"), F.greatest(best, bids[-1])["to"].alias("grown_shard"))


def write_shards(
    df: DataFrame, path: str, shards: int, key: str, text: str,
    seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Write ``df`` shuffled into ``shards`` folders ``shard=i`` under ``path``.

    Files hold the columns of ``df`` and ``grown_shard``, ``bucket`` (number
    within the shard) and ``place`` (within the bucket).  A bucket's records
    are gathered in one row, so their number is set from the table's bytes.
    """
    df = df.drop(*ADDED)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    n = shards * per_shard
    order = fresh("_order", df.columns)
    record = F.struct(F.xxhash64(F.lit(seed), *df.columns).alias(order), *df.columns)
    picked = df.select(pick_shard(key, seed, shards).alias("to"), record.alias("record"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(f"record.{order}")), F.lit(per_shard))
    dealt = picked.select(
        F.col("to.shard").alias("shard"), F.col("to.grown_shard").alias("grown_shard"),
        bucket.cast("int").alias("bucket"), "record",
    ).repartition(n, "shard", "bucket")
    gathered = dealt.groupBy("shard", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("record", "grown_shard"))).alias("rows")
    )
    # In a fixed order of records and buckets, the seed decides the result.
    shuffled = gathered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    placed = shuffled.select("shard", "bucket", F.posexplode("rows").alias("place", "row"))
    placed.select(
        "shard", "bucket", "place", "row.grown_shard",
        *[F.col("row.record").getField(c).alias(c) for c in df.columns],
    ).write.partitionBy("shard").parquet(path)


def written_schema(df: DataFrame) -> T.StructType:
    """Schema of what ``write_shards`` writes for ``df``."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in ADDED])
    for name in ("grown_shard", "bucket", "place", "shard"):
        schema = schema.add(name, T.IntegerType())
    return schema


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """The records of ``df`` as written, with ``slot``, gapless from 0 in every shard."""
    rows = df.sparkSession.read.schema(written_schema(df)).parquet(path)
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Written, so that its size is known and the records need not move to meet it.
    offsets = checkpoint(counts.select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    ))
    slot = (F.col("_before") + F.col("place")).cast("long")
    return rows.join(offsets, ["shard", "bucket"]).withColumn("slot", slot).drop("_before")
