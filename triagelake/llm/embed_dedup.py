"""Near-duplicate vectors by collision counting on one-dimensional projections.

Two unit vectors at cosine ``c`` lie ``sqrt(2 - 2c)`` apart, and their places
on a random line differ by a normal variable of that deviation.  A vector's
query-centred window on a line holds its neighbour with a known probability;
the number of ``LINES`` windows that hold it is binomial, and the least count
asked of a pair is the one that a pair at the threshold misses once in
``1 / MISS``.  Pairs that reach it are verified in double precision.

On one line alone a window that wide holds a quarter of all unrelated
vectors, so windows are compared only inside cells: a cell is the side of the
middle on each of ``bits`` further lines, in ``tables`` sets of lines.  The
bits grow with the logarithm of the table and the tables follow from them, so
that a pair at the threshold shares a cell in one of them with probability
``1 - MISS``.  A pair is counted in the first table whose cell it shares.
Cells with many vectors are cut into blocks, every two of which meet.

Equal vectors are one class, counted with its multiplicity; classes carry
numbers of their own through tiles and graph, and ids come back at the end.
Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components link with nothing and are kept; vectors of different length never
link; rows that repeat an id are vectors of their own that share it; rows of
NULL id link like any other and have the least id of their component, NULL
where none has one, and then they are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.arrow import bounds, sorted_groups, tidy
from triagelake.llm.graph import EDGES, components
from triagelake.llm.ngram_join import blocked
from triagelake.session import checkpoint

COSINE = 0.9
LINES = 48
MISS = 0.01
CELL = 64  # vectors that a cell is meant to hold
SORTED = 512  # from so many, sorting a tile's lines pays
TILE = 2048
SEED = 11
FOUND = "a long, b long, links long"


def directions(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, size]).standard_normal((size, count))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a cell and number of tables for ``n`` vectors."""
    bits = min(48, max(1, math.ceil(math.log2(max(2, n / CELL)))))
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - shared))) if shared < 1 else 1


def window(cosine: float = COSINE, miss: float = MISS) -> tuple[float, int]:
    """Half width of the windows and the least count of collisions."""
    width = math.sqrt(2 - 2 * cosine)
    p = 2 * normal_cdf(1.0) - 1
    left, least = 0.0, 0
    while True:
        left += math.comb(LINES, least) * p**least * (1 - p) ** (LINES - least)
        if left > miss:
            return width, least
        least += 1


def unit(vectors) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells(bits: int, tables: int):
    """Add to classes the cell of each table; vectors of one length at a time."""

    def run(batches):
        lines: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        kind = np.int32 if bits < 32 else np.int64
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), kind)
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in lines:
                    lines[size] = directions(size, bits * tables, 0)
                for i in range(0, len(at), 2048):
                    some = at[i : i + 2048]
                    side = unit([vectors[k] for k in some]) @ lines[size] > 0
                    out[some] = side.reshape(len(some), tables, bits) @ weight
            yield pa.record_batch([*batch.columns, pa.array(list(out), pa.list_(pa.from_numpy_dtype(kind)))], names=[*batch.schema.names, "cells"])

    return run


def counted(queries: np.ndarray, others: np.ndarray, width: float) -> np.ndarray:
    """On how many lines each query's window holds each of the others."""
    count = np.zeros((len(queries), len(others)), np.uint8)
    for q, o in zip(queries.T, others.T):
        if len(others) < SORTED:
            count += (o >= (q - width)[:, None]) & (o <= (q + width)[:, None])
            continue
        order = np.argsort(o, kind="stable")
        ranked = o[order]
        # A window is a run of the sorted line: mark its ends and add up.
        mark = np.zeros((len(q), len(o) + 1), np.int8)
        mark[np.arange(len(q)), np.searchsorted(ranked, q - width)] += 1
        mark[np.arange(len(q)), np.searchsorted(ranked, q + width, side="right")] -= 1
        count[:, order] += np.cumsum(mark[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    return count


def collisions(cosine: float):
    """Links of the tiles in batches sorted by ``tile``: a row for each vector
    with the number of its links, and links that span each tile's groups."""
    width, least = window(cosine)

    def pairs(ids, vectors, side, cell, own):
        """Pairs of a tile that collide often enough and are near."""
        if side.min() == 1:  # the other block is empty, and this one has a tile of its own
            return
        lines = vectors @ directions(vectors.shape[1], LINES, 1)
        first = np.flatnonzero(side == side.min())
        two = side.min() != side.max()
        for i in range(0, len(first), 256):
            q = first[i : i + 256]
            c = np.flatnonzero(side == side.max()) if two else np.arange(int(q[0]), len(ids))
            x, y = np.nonzero(counted(lines[q], lines[c], width) >= least)
            x, y = q[x], c[y]
            keep = (x < y) if not two else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            same = cell[x] == cell[y]
            earlier = same.argmax(axis=1) if len(x) else x
            x, y = x[earlier == own], y[earlier == own]
            near = (vectors[x] * vectors[y]).sum(axis=1) >= cosine
            yield x[near], y[near]

    def run(batches):
        flat = lambda lists, rows: np.asarray(lists.flatten()).reshape(rows, -1)
        for table in sorted_groups(batches, "tile"):
            cut = bounds(table.column("tile").to_numpy())
            columns = {c: table.column(c).combine_chunks() for c in ("node", "copies", "side", "own", "vector", "cells")}
            a, b, n = [], [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                part = {c: v.slice(s, e - s) for c, v in columns.items()}
                ids, copies, side, own = (part[c].to_numpy(zero_copy_only=False) for c in ("node", "copies", "side", "own"))
                vectors = unit(flat(part["vector"], len(ids)))
                cell = flat(part["cells"], len(ids))
                links = np.zeros(len(ids), np.int64)
                up = np.arange(len(ids))
                for x, y in pairs(ids, vectors, side, cell, int(own[0])):
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    for i, j in zip(x.tolist(), y.tolist()):
                        while up[i] != i:
                            up[i] = i = up[up[i]]
                        while up[j] != j:
                            up[j] = j = up[up[j]]
                        up[max(i, j)] = min(i, j)
                for i in np.flatnonzero(links):
                    a.append(ids[i])
                    b.append(ids[up[i]])
                    n.append(links[i])
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "links"])

    return run


def dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # Single precision is half to ship; arithmetic is double.
    item = getattr(df.schema[vector].dataType, "elementType", None)
    sort = "float" if isinstance(item, T.FloatType) else "double"
    v = F.col(vector).cast(f"array<{sort}>")
    fit = F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(fit, v).alias("vector"))
    # Zeros of either sign are one number.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: (x + F.lit(0.0)).cast(sort)))
    rows = checkpoint(rows.withColumn("cls", F.xxhash64("vector")))
    classes = checkpoint(
        rows.where("vector is not null").groupBy("cls", "vector")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bits, tables = plan(classes.count(), cosine)
    schema = f"node long, copies long, vector array<{sort}>, cells array<{'int' if bits < 32 else 'long'}>"
    placed = checkpoint(classes.select("node", "copies", "vector").mapInArrow(tidy(cells(bits, tables)), schema))
    each = placed.select("node", "copies", "vector", "cells", F.posexplode("cells").alias("own", "cell"))
    each = each.withColumn("size", F.size("vector"))
    large = each.groupBy("own", "cell", "size").count().where(F.col("count") > TILE)
    each = each.join(checkpoint(large), ["own", "cell", "size"], "left")
    tiles = blocked(each, ["own", "cell", "size"], "count", F.lit(TILE), "node")
    tiles = tiles.select("tile", "side", "own", "node", "copies", "vector", "cells")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile")
    found = checkpoint(tiles.mapInArrow(tidy(collisions(cosine)), FOUND))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "node", "left").join(components(found.select("a", "b")), "node", "left").select(
        "cls", "vector", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select("cls", "vector", "n_links", "component_id")
    out = rows.join(known, ["cls", "vector"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
