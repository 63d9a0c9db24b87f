"""Header CSV with multi-line text, read by many tasks.

A line break inside quotes doesn't end a record, so where a range of a file
begins inside a record is known only from the quotes before it.  Quotes stand
around fields and are doubled inside them, so their number up to a place is odd
exactly inside a field:

1. every range counts its quotes;
2. running sums over a file's ranges tell each one whether it begins inside;
3. every range cuts its lines into records; only what crosses its borders, two
   pieces at most, is put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.session import checkpoint

PIECE = "record string, path string, block long, at long, opens boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, value``: every line, with the file range it begins in."""
    text = spark.read.option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    return text.select(*where, "value")


def inside(rows: DataFrame) -> DataFrame:
    """``path, block, inside``: whether each range begins inside quotes; one row per range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = rows.groupBy("path", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("path", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class Range:
    """The records of one range, from its lines in order."""

    def __init__(self, path: str, block: int, inside: bool):
        self.path, self.block, self.inside = path, block, inside
        self.held: list[str] = []
        self.begun = not inside  # False while in a record of an earlier range
        self.skip = block == 0  # the header
        self.at = 0

    def piece(self, text: str, opens: bool) -> tuple:
        self.at += 1
        return text, self.path, self.block, self.at, opens

    def add(self, values: pa.Array) -> Iterator[tuple]:
        """Whole records, with NULL path, and a piece that ends an earlier record."""
        count = pc.count_substring(values, '"').to_numpy()
        after = (np.cumsum(count) + self.inside) % 2
        ends = np.flatnonzero(after == 0)
        start = 0
        for end in ends.tolist():
            text = "\n".join([*self.held, *values[start : end + 1].to_pylist()])
            self.held, start = [], end + 1
            if not self.begun:
                self.begun = True
                yield self.piece(text, False)
            elif self.skip:
                self.skip = False
            else:
                yield text, None, None, None, None
        self.held += values[start:].to_pylist()
        self.inside = bool(after[-1]) if len(after) else self.inside

    def rest(self) -> Iterator[tuple]:
        """What the next range goes on with."""
        if self.held:
            text, *where, at, opens = self.piece("\n".join(self.held), self.begun)
            # A header that crosses the border is known by its number.
            yield text, *where, 0 if self.skip else at, opens


def cut(batches) -> Iterator[pa.RecordBatch]:
    """Records and pieces of the ranges in a task's lines."""
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["record", "path", "block", "at", "opens"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=names)

    now = None
    for batch in batches:
        path, block, flag = (batch.column(c) for c in ("path", "block", "inside"))
        same = np.ones(batch.num_rows, bool)
        same[1:] = pc.equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) & (block.to_numpy()[1:] == block.to_numpy()[:-1])
        edges = [0, *np.flatnonzero(~same).tolist(), batch.num_rows] if batch.num_rows else []
        out = []
        for s, e in zip(edges, edges[1:]):
            key = path[s].as_py(), block[s].as_py()
            if now is None or key != (now.path, now.block):
                out += now.rest() if now else []
                now = Range(*key, flag[s].as_py())
            out += now.add(batch.column("value").slice(s, e - s))
        yield batch_of(out)
    if now:
        yield batch_of(list(now.rest()))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every record but the headers."""
    rows = lines(spark, path)
    # A line per range, as many as the driver has tasks to plan.
    known = F.broadcast(checkpoint(inside(rows)))
    found = checkpoint(rows.join(known, ["path", "block"]).select("path", "block", "inside", "value").mapInArrow(cut, PIECE))
    order = Window.partitionBy("path").orderBy("block", "at")
    pieces = found.where("path is not null").withColumn("n", F.sum(F.col("opens").cast("int")).over(order))
    whole = pieces.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("block", "at", "record"))).alias("p"))
    whole = whole.where(~((F.col("p")[0]["block"] == 0) & (F.col("p")[0]["at"] == 0)))
    joined = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    return found.where("path is null").select("record").union(whole.select(joined))


def read(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """Header CSV under ``path`` with an explicit schema."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    given = {"escape": '"', "multiLine": "true", **{k: str(v) for k, v in options.items()}}
    text = records(spark, path).select(F.regexp_replace("record", "\r$", "").alias("record")).where("record != ''")
    return text.select(F.from_csv("record", ddl, given).alias("row")).select("row.*")
