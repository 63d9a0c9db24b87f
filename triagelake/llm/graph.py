"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrow import tidy
from triagelake.session import checkpoint

EDGES = "a long, b long"


class Forest:
    """Union-find over numbers from 0; a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def contract(batches):
    """Of each million of links, a link from every node to the least it reaches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > 1 << 20:
            yield from _stars(held)
            held, n = [], 0
    yield from _stars(held)


def _stars(held):
    if not held:
        return
    table = pa.Table.from_batches(held)
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        forest.join(x, y)
    root = np.array([forest.root(x) for x in range(len(nodes))], dtype=np.int64)
    out = root != np.arange(len(nodes))
    yield pa.record_batch([pa.array(nodes[out]), pa.array(nodes[root[out]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the least node reached.

    Links are contracted inside tasks, then large-star and small-star rounds
    run until nothing changes; joins on hot nodes are split by the engine.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    stars = checkpoint(links.mapInArrow(tidy(contract), EDGES).distinct())
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        after = checkpoint(small)
        if state(after) == state(stars):
            break
        stars = after
    roots = after.select(F.col("b").alias("node")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def state(links: DataFrame) -> tuple:
    """A fingerprint of a link table."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.col("a").cast("decimal(38)")), F.sum(F.col("b").cast("decimal(38)"))).first())
