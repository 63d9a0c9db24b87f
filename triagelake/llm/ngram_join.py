"""Jaccard self-join of word shingle sets, in size-banded tiles with bitmaps.

A set's bitmap holds the parity of its hashes per bit, about as many bits as
the set has members, so sets that differ in ``d`` members have bitmaps that
differ in ``d`` bits at most; that bounds the overlap from above before any
array is intersected.  Sets of one size band and its neighbour can reach the
threshold only.  Comparing all of them would grow with the square of the
table, so a tile holds, of two neighbouring bands, the sets that also agree in
one of ``KEYS`` keys, each of ``ROWS`` least hashes; two sets at a Jaccard of
0.8 share no key with probability 1e-6, more similar ones much less.

1. Every text becomes a size, a hash of its set, a bitmap and keys.  Equal
   sets are one class from here on.
2. Each tile gives the links of a spanning forest of the sets that the bitmap
   bound lets through: at most one less than its members.  Large keys are
   cut into blocks, and every two blocks of a key meet in a tile of their own.
3. Components of those links are clusters that no true link leaves.  Each
   cluster's sets are brought together once, in blocks if it is large, and
   intersected as sorted arrays wherever the bound admits a pair that is not
   yet connected.
4. Components of the true links are the result.

Words: A-Z lower-cased, split at ASCII white space.  Members are 64-bit
hashes of five words each.  Classes carry numbers of their own through tiles
and graph; ids come back at the end.  Defined results: NULL, empty and blank
texts have the empty set and stay alone; fewer than five words are one shingle;
rows that repeat an id are one document, linked when one of its texts is; rows
of NULL id are documents of their own, link like any other and have the least
id of their component, NULL where none has one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrow import bounds, mix, pieces, record_batches, sorted_groups, tidy, utf8, words
from triagelake.llm.graph import EDGES, Forest, components
from triagelake.session import checkpoint, measured

SHINGLE = 5
PERCENT = 80
KEYS, ROWS = 20, 3
TILE = 4096
TILE_BYTES = 8 << 20
LEAST_BITS, MOST_BITS = 128, 1 << 16
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) for i in range(SHINGLE + KEYS * ROWS)], np.uint64)
FLIP = mix(np.arange(1, KEYS * ROWS + 1, dtype=np.uint64))
SKETCH = "n long, bytes long, cls long, bitmap binary, keys array<long>"


def shingle_sets(data, off, i, j):
    """Sorted distinct shingle hashes of rows ``i`` to ``j``, and each row's bounds."""
    h, cut, *_ = words(data, off, i, j)
    n = np.diff(cut)
    take = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    long_ = np.zeros(len(h), np.uint64)
    if len(h) >= SHINGLE:
        last = len(h) - SHINGLE + 1
        long_[:last] = mix(sum(h[k : last + k] * ODD[k] for k in range(SHINGLE)))
    row = np.repeat(np.arange(j - i), take)
    at = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(take)[:-1]] - cut[:-1], take)
    out = long_[at]
    ends = np.r_[0, np.cumsum(take)]
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        w = h[cut[r] : cut[r + 1]]
        out[ends[r]] = mix(np.array([(w * ODD[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.searchsorted(row[new], np.arange(j - i + 1))


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` members: its size band."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(n).bit_length()))


def bitmap(members: np.ndarray, bits: int) -> bytes:
    at = (members >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch(batches):
    """Per text: id, hash, set size, bytes, hash of the set, bitmap and tile keys."""
    for batch in record_batches(batches):
        data, off = utf8(batch.column("_text"))
        for i, j in pieces(off, 1 << 19):
            s, cut = shingle_sets(data, off, i, j)
            n = np.diff(cut)
            full = np.flatnonzero(n)
            start = cut[:-1][full]
            cls = np.zeros(j - i, np.uint64)
            maps, keys = [b""] * (j - i), [[]] * (j - i)
            if len(full):
                cls[full] = mix(np.add.reduceat(mix(s ^ ODD[0]), start) + n[full].astype(np.uint64))
                turned = (s ^ FLIP[k] for k in range(KEYS * ROWS))
                least = [np.minimum.reduceat(x * ODD[SHINGLE + k], start) for k, x in enumerate(turned)]
                kept = np.zeros((len(full), KEYS), np.uint64)
                for k in range(KEYS):
                    three = least[k * ROWS : (k + 1) * ROWS]
                    kept[:, k] = mix(sum(x * ODD[m] for m, x in enumerate(three)) + np.uint64(k))
                for r, row in zip(full.tolist(), kept.view(np.int64)):
                    maps[r] = bitmap(s[cut[r] : cut[r + 1]], bits_for(n[r]))
                    keys[r] = row
            yield pa.record_batch(
                [
                    batch.column("id").slice(i, j - i), batch.column("hash").slice(i, j - i), pa.array(n.astype(np.int64)),
                    pa.array(np.diff(off[i : j + 1])), pa.array(cls.view(np.int64)),
                    pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "hash", "n", "bytes", "cls", "bitmap", "keys"],
            )


def folded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of at most two neighbouring bands at the lesser width, as 64-bit words.

    Hashes keep their low bits when a bitmap is halved, and parities add.
    """
    size = min(map(len, raw))
    out = np.zeros((len(raw), size), np.uint8)
    for i, b in enumerate(raw):
        for part in np.frombuffer(b, np.uint8).reshape(-1, size):
            out[i] ^= part
    return out.view(np.uint64)


def admitted(n, maps, i: int, others: np.ndarray) -> np.ndarray:
    """Of ``others``, those whose overlap with ``i`` may reach the threshold."""
    apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
    total = n[others] + n[i]
    most = np.minimum((total - apart) // 2, np.minimum(n[others], n[i]))
    return others[100 * most >= PERCENT * (total - most)]


def forest(n, raw, side, check=None):
    """Links of a spanning forest of the admitted pairs (that pass ``check``).

    ``side`` is 0 or 1 for the two blocks of a tile; pairs within one block
    belong to that block's own tile.  Members reached are not compared again,
    so a group of near copies takes one pass.
    """
    maps = folded(raw)
    two = side.min() != side.max()
    left = np.arange(len(n))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            others = left[side[left] != side[i]] if two else left
            near = admitted(n, maps, i, others)
            if check is not None:
                near = np.array([j for j in near.tolist() if check(i, j)], np.int64)
            for j in near.tolist():
                yield i, j
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)


def tiles(batches):
    """Forest links between nodes of the tiles in batches sorted by ``tile``."""
    for table in sorted_groups(batches, "tile"):
        cut = bounds(table.column("tile").to_numpy())
        n, ids = table.column("n").to_numpy(), table.column("node").to_numpy()
        side, raw = table.column("side").to_numpy(), table.column("bitmap").to_pylist()
        a, b = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for i, j in forest(n[s:e], raw[s:e], side[s:e]):
                a.append(ids[s + i])
                b.append(ids[s + j])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def exact(batches):
    """Forest of the true links of each ``tile`` of texts."""
    for table in sorted_groups(batches, "tile"):
        cut = bounds(table.column("tile").to_numpy())
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = table.slice(s, e - s)
            data, off = utf8(part.column("_text"))
            sets = []
            for i, j in pieces(off):
                m, c = shingle_sets(data, off, i, j)
                sets += [m[c[k] : c[k + 1]] for k in range(j - i)]
            n = np.array([len(x) for x in sets])
            # Clusters may span bands; bitmaps of one width for all.
            bits = bits_for(int(np.median(n)))
            ids = part.column("node").to_numpy()

            def linked(i, j, sets=sets):
                x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                return 100 * both >= PERCENT * (len(x) + len(y) - both)

            links = list(forest(n, [bitmap(x, bits) for x in sets], part.column("side").to_numpy(), linked))
            yield pa.record_batch([pa.array([ids[k[w]] for k in links], pa.int64()) for w in (0, 1)], names=["a", "b"])


def blocked(df: DataFrame, group: list[str], count: str, most, order) -> DataFrame:
    """Add ``tile`` and ``side``: groups over ``most`` are cut into blocks, and
    each row goes to the tile of its block and to one with every other block."""
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int")
    df = df.withColumn("_of", n).withColumn("_block", F.pmod(F.xxhash64(order), F.col("_of")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    df = df.withColumn("tile", F.xxhash64(*group, low, high))
    return df.withColumn("side", (F.col("_block") == high).cast("int") * (low != high).cast("int")).drop("_of", "_block", "_other")


def streamed(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over partitions that hold whole tiles, sorted by tile."""
    return df.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(run), schema)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE, hashed: bool = False) -> DataFrame:
    """``key, n_shingles, component_id`` for every row, and ``text_hash`` if ``hashed``."""
    source = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("_text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:2])
    sketches = checkpoint(source.mapInArrow(tidy(sketch), f"{kept}, {SKETCH}"))
    full = sketches.where("n > 0")
    classes = checkpoint(
        full.groupBy("cls", "n").agg(
            F.min("id").alias("id"), F.min(F.struct("id", "hash")).alias("one"), F.first("bytes").alias("bytes"),
            F.first("bitmap").alias("bitmap"), F.first("keys").alias("keys"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    # A band ends where its bitmaps' bits do; the sets near enough to its end
    # to reach the threshold with one beyond it go to the next tile too.
    band = 8 * F.octet_length("bitmap")
    near = F.when(100 * F.col("n") >= PERCENT * band, F.array(band, 2 * band)).otherwise(F.array(band))
    keyed = classes.select("node", "n", "bitmap", "keys", F.explode(near).alias("band"))
    rows = keyed.select("node", "n", "bitmap", "band", F.explode("keys").alias("key"))
    large = rows.groupBy("key", "band").count().where(F.col("count") > tile)
    rows = rows.join(checkpoint(large), ["key", "band"], "left")
    rows = blocked(rows, ["key", "band"], "count", F.lit(tile), "node")
    links = streamed(rows.select("tile", "side", "node", "n", "bitmap"), tiles, EDGES)
    clusters = checkpoint(components(links).withColumnRenamed("component", "cluster"))
    members = clusters.join(classes.select("node", "bytes", "one"), "node")
    sizes = members.groupBy("cluster").agg(F.sum("bytes").alias("size"))
    members = checkpoint(members.join(sizes, "cluster").select("cluster", "node", "size", "one"))
    # One text of each set; rows that repeat id and text are one.  Texts of no
    # cluster are left behind by their hashes before any text moves.
    hashes = measured(members.select(F.col("one.hash").alias("wanted")))
    near = source.join(hashes, F.col("hash") == F.col("wanted"), "left_semi")
    texts = near.join(members, near["id"].eqNullSafe(F.col("one.id")) & (near["hash"] == F.col("one.hash")))
    texts = texts.select("cluster", "size", "node", "_text").dropDuplicates(["node"])
    texts = blocked(texts, ["cluster"], "size", F.lit(TILE_BYTES), "node")
    true = streamed(texts.select("tile", "side", "node", "_text"), exact, EDGES)
    found = components(true.union(same_document(full, classes)))
    placed = classes.join(found, "node", "left").select("cls", "n", "id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    least = placed.join(least, "component").select("cls", "n", "component_id")
    told = full.join(least, ["cls", "n"]).select("id", "n", "component_id", "hash")
    # A row without words has the component of its document's other rows.
    bare = sketches.where("n = 0").select("id", "n", "hash")
    other = told.where("id is not null").join(bare.select("id").distinct(), "id", "left_semi")
    other = other.groupBy("id").agg(F.min("component_id").alias("component_id"))
    told = told.union(bare.join(other, "id", "left").select("id", "n", "component_id", "hash"))
    return told.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"), *([F.col("hash").alias("text_hash")] if hashed else []),
    )


def same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id."""
    again = rows.where("id is not null").groupBy("id").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    again = checkpoint(again.where("low != high").select("id", "low"))
    pairs = rows.join(again, "id").select("cls", "low").distinct()
    node = classes.select("cls", "node")
    return pairs.join(node, "cls").join(node.select(F.col("cls").alias("low"), F.col("node").alias("b")), "low").select(
        F.col("node").alias("a"), "b"
    )
