"""Exact TF-IDF top-k from a postings table, with bounds on what can still win.

Weights are never negative and rows have unit length, so

- the sum over some of a query's terms is a lower bound of a score, and the
  k-th largest such sum bounds the query's k-th score from below (``floor``);
- terms left out can add no more than the length of the query's remainder, nor
  more than each term's largest weight in the corpus allows (``rest``).

1. Queries with few postings in all look all of them up, and sums are scores.
   For the others the terms that cost least for what they weigh, rare ones
   first, are looked up and give the floor.
2. More of their terms are looked up until the rest is well below the floor; a row that
   holds none of them cannot be among the best k.  Where that takes most of
   the query's postings, all are looked up and sums are scores.
3. Rows whose sum and rest together reach the floor are completed from both
   vectors; all others never are.

Postings are lists per term and range of rows, and queries come in blocks, so
a list is shipped once per block that looks it up; no row of a pair is.  Sums
are formed in numpy, per block and range.  Where there are many blocks and
ranges, some blocks are searched after the others, so that what is shipped for
them lies on disk in part only.  What is shuffled of the corpus is
its texts (by id, so that numbers rise with ids and ties go to the smaller one),
its terms (by 64-bit hash, as packed numbers) and of these the asked ones (by row
and by term), whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import fixed
from triagelake.operators import features
from triagelake.session import checkpoint, discard

# Queries of a block and rows of a range, as powers of two.
BLOCK, RANGE = 9, 14
# Postings are shipped once for some blocks together, so many as leave ``TILES``
# of them, and 2 ** ``SPAN`` at most.
TILES, SPAN = 24, 5
# Parts of the queries that are searched one after the other, at most.
WAVES = 8
# Postings that a query may look up without asking what they bring.
CHEAP = 200_000
# Postings looked up per query for the floor.
SEED = 2000
# The rest that may stay behind, as a share of the floor.
REST = 0.5
# Of a query's postings, the share from which all are looked up.
WHOLE = 0.4
# Scores are compared at this precision, so that equal rows tie.
DIGITS = 9
SLACK = 2e-9
# Sums formed at a time.
CHUNK = 1 << 21
PARTS = ("docs", "terms", "postings", "vectors")
# Tables in buckets have no file that tells the schema when they are empty.
BUCKETED = {
    "terms": ("term", "term string, df bigint, idf double, tid bigint, top double"),
    "postings": ("tid", "tid bigint, range bigint, rows array<struct<c: int, w: double>>"),
}
# Entries of the terms that a task holds at a time.
HELD = 1 << 22
# A row's term: its hash, the row's place in its range, how often it occurs; no row's (range -1) if it is asked.
ENTRY = np.dtype([("h", "<i8"), ("c", "<u2"), ("tf", "<u4")])
DEALT = "part int, range long, entries binary"
LISTED = "h long, tid long, df long, range long, c array<smallint>, tf array<int>, w array<double>"
LOOKUP = "block long, tid long, asked binary"
# What a block asks of a term, per query: its place, weight, and the sum that matters.
ASKED = np.dtype([("q", "<u2"), ("w", "<f8"), ("least", "<f4")])
FOUND = "qid long, cid long, score double, whole boolean"


# --- the index ----------------------------------------------------------------

def numbered_counts(df: DataFrame, key: str, column: str, ngrams, number: str, ordered: bool = False) -> DataFrame:
    """``key, number, counts`` of every text; numbers rise with the key if ``ordered``."""
    rows = df.select(key, column)
    # Dealt out before the texts are cut into terms, which is the costly part.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.orderBy(key) if ordered else rows.repartition(tasks)
    counted = features.term_counts(features.with_terms(rows, column, ngrams), key)
    return checkpoint(counted.withColumn(number, F.monotonically_increasing_id()))


def build(corpus: DataFrame, ngrams=(1, 2), asked: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index of ``corpus (corpus_id, text)``: its ``PARTS`` as DataFrames.

    ``asked`` lists the distinct terms that will be looked up; others count for the
    length of a row, but have no postings.  Terms are told apart by 64 bits.
    """
    counts = numbered_counts(corpus, "corpus_id", "text", ngrams, "cid", ordered=True)
    if asked is None:
        asked = counts.select(F.explode("counts.term").alias("term")).distinct()
    asked = asked.select("term", F.xxhash64("term").alias("h"))
    n, size = counts.agg(F.count("*"), F.coalesce(F.sum(F.size("counts.tf")), F.lit(0))).first()
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // HELD))
    hashed = F.transform("counts.term", lambda t: F.xxhash64(t)).alias("h")
    entries = counts.select("cid", hashed, "counts.tf").mapInArrow(dealt(parts), DEALT)
    own = asked.select(F.lit(-1).cast("long").alias("cid"), F.array("h").alias("h"), F.array(F.lit(0).cast("long")).alias("tf"))
    entries = entries.union(own.mapInArrow(dealt(parts), DEALT))
    found = checkpoint(entries.groupBy("part").applyInArrow(listed(n), LISTED))
    idf = (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf")
    terms = checkpoint(asked.join(found.where("h is not null"), "h").select("term", "df", idf, "tid"))
    raw = found.where("tid is not null").select("range", "tid", idf, F.inline(F.arrays_zip("c", "tf")))
    raw = raw.select(F.shiftleft("range", RANGE) + F.col("c"), (F.ln("tf") + 1) * F.col("idf"), "tid").toDF("cid", "w", "tid")
    others = found.where("tid is null").groupBy("range").applyInArrow(lengths, "cid long, w double, tid long")
    vectors = checkpoint(unit(raw.union(others), "cid", F.struct("tid", "w"), ["tid"]))
    discard(found)
    place = F.col("cid").bitwiseAND((1 << RANGE) - 1).cast("int").alias("c")
    postings = checkpoint(
        vectors.select("cid", F.inline(F.arrays_zip("tid", "w")))
        .groupBy("tid", F.shiftright("cid", RANGE).alias("range"))
        .agg(F.collect_list(F.struct(place, "w")).alias("rows"), F.max("w").alias("top"))
    )
    top = postings.groupBy("tid").agg(F.max("top").alias("top"))
    parts = counts.select("corpus_id", "cid"), terms.join(top, "tid"), postings.drop("top"), vectors
    return dict(zip(PARTS, parts))


def unit(raw: DataFrame, key: str, entry: Column, kept: list[str]) -> DataFrame:
    """``key``, arrays ``kept`` and ``w`` scaled to unit length; entries of NULL ``tid`` count for the length alone."""
    rows = raw.groupBy(key).agg(
        F.collect_list(F.when(F.col("tid").isNotNull(), entry)).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")
    )
    return rows.select(key, *[F.col(f"e.{c}").alias(c) for c in kept], F.transform("e.w", lambda w: w / F.col("n")).alias("w"))


def save(index: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Write an index under ``path``; postings and terms lie in sorted buckets."""
    for part in ("docs", "vectors"):
        index[part].write.mode("overwrite").parquet(f"{path}/{part}")
    for part, (by, _) in BUCKETED.items():
        name = table_name(path, part)
        whole = index[part].repartition(buckets, by)  # one file per bucket
        writer = whole.write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
        writer.option("path", f"{path}/{part}").saveAsTable(name)


def table_name(path: str, part: str) -> str:
    """A catalog name for a part of the index at ``path``."""
    return f"index_{abs(hash_of(path)):x}_{part}"


def hash_of(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8])


def load(spark: SparkSession, path: str, buckets: int = 64) -> dict[str, DataFrame]:
    """An index written by ``save``, by this session or another."""
    index = {}
    for part in PARTS:
        if part not in BUCKETED:
            index[part] = spark.read.parquet(f"{path}/{part}")
            continue
        name, (by, columns) = table_name(path, part), BUCKETED[part]
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}/{part}') "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
            )
        index[part] = spark.table(name)
    return index


# --- inside tasks -------------------------------------------------------------

def lists(column) -> tuple[np.ndarray, pa.Array]:
    """Bounds of a list column's rows, and its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    return off - off[0], column.flatten()


def packed(entries: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Entries as bytes, one value per row; most terms have one entry, which as arrays would take several times that."""
    ends = (bounds * entries.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(entries.tobytes())])


def unpacked(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows' entries, and the entries."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    off = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    size = int(off[-1] - off[0]) // kind.itemsize
    return (off - off[0]) // kind.itemsize, np.frombuffer(data, kind, size, int(off[0]))


def dealt(parts: int):
    """Terms of rows, dealt to parts by their hash, as bytes per range of rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, features.COUNTED):
                batch = whole.slice(start, features.COUNTED)
                off, h = lists(batch.column("h"))
                cid = np.repeat(batch.column("cid").to_numpy(), np.diff(off))
                mine = np.empty(len(cid), ENTRY)
                mine["h"], mine["tf"] = h.to_numpy(), lists(batch.column("tf"))[1].to_numpy()
                mine["c"] = cid & ((1 << RANGE) - 1)
                part, range_ = (mine["h"].astype(np.uint64) % np.uint64(parts)).astype(np.int64), cid >> RANGE
                order = np.lexsort((range_, part))
                part, range_ = part[order], range_[order]
                edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (range_[1:] != range_[:-1])]) if len(part) else order
                data = [pa.array(part[edge].astype(np.int32)), pa.array(range_[edge]), packed(mine[order], np.append(edge, len(part)))]
                yield pa.record_batch(data, names=["part", "range", "entries"])

    return run


def listed(n: int):
    """Of a part, the asked terms with their rows per range (``h`` with the first),
    and what all others add to the lengths of each range's rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("range").to_numpy(), kind="stable"))
        bounds, entries = unpacked(table.column("entries"), ENTRY)
        range_ = np.repeat(table.column("range").to_numpy(), np.diff(bounds))
        order = np.argsort(entries["h"], kind="stable")
        h, at = entries["h"][order], range_[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.append(first, len(h)))
        asks = np.add.reduceat((at < 0).astype(np.int64), first)
        df = size - asks
        wanted = np.repeat(asks > 0, size)
        # Rows of asked terms, by term and range.
        term = np.repeat(np.arange(len(first)), size)
        mine = np.flatnonzero(wanted & (at >= 0))
        tids = (table.column("part")[0].as_py() << 32) + np.arange(len(first))
        row, place = entries[order[mine]], term[mine]
        edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[mine][1:] != at[mine][:-1])]) if len(mine) else mine
        told, again = place[edge], np.r_[False, place[edge][1:] == place[edge][:-1]][: len(edge)]
        ends = pa.array(np.append(edge, len(mine)).astype(np.int32))
        asked = [
            pa.array(h[first][told], mask=again), pa.array(tids[told]), pa.array(df[told]), pa.array(at[mine][edge]),
            pa.ListArray.from_arrays(ends, pa.array(row["c"].astype(np.int16))),
            pa.ListArray.from_arrays(ends, pa.array(row["tf"].astype(np.int32))), pa.nulls(len(edge), pa.list_(pa.float64())),
        ]
        # Squares of the others, put back into the order of ranges.
        idf = np.log((1 + n) / (1 + df)) + 1
        square = np.empty(len(h))
        square[order] = np.where(wanted, 0.0, idf[term])
        square = ((np.log(np.maximum(entries["tf"], 1)) + 1) * square) ** 2
        ranges, starts = np.unique(range_, return_index=True)
        seen, places, sums_ = [], [], []
        for r, s, e in zip(ranges.tolist(), starts.tolist(), [*starts[1:].tolist(), len(range_)]):
            total = np.bincount(entries["c"][s:e], square[s:e])
            some = np.flatnonzero(total)
            if len(some):
                seen.append(r)
                places.append(some.astype(np.int16))
                sums_.append(np.sqrt(total[some]))
        k = len(seen)
        others = [
            *[pa.nulls(k, pa.int64())] * 3, pa.array(seen, pa.int64()), pa.array(places, pa.list_(pa.int16())),
            pa.nulls(k, pa.list_(pa.int32())), pa.array(sums_, pa.list_(pa.float64())),
        ]
        names = ["h", "tid", "df", "range", "c", "tf", "w"]
        return pa.concat_tables([pa.table(asked, names), pa.table(others, names)])

    return run


def lengths(table: pa.Table) -> pa.Table:
    """What the terms that are not asked add to the length of each row of a range."""
    c, w = (lists(table.column(x))[1].to_numpy() for x in ("c", "w"))
    total = np.bincount(c, w * w)
    some = np.flatnonzero(total)
    cid = (table.column("range")[0].as_py() << RANGE) + some
    return pa.table([pa.array(cid), pa.array(np.sqrt(total[some])), pa.nulls(len(some), pa.int64())], ["cid", "w", "tid"])


def tails(w: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The most that the terms from each place on can add."""
    length = np.sqrt(np.cumsum((w * w)[::-1])[::-1])
    most = np.cumsum((w * top)[::-1])[::-1]
    return np.append(np.minimum(length, most), 0.0)


def chosen(tid, w, df, top, floor: float, first: bool) -> tuple[np.ndarray, float, bool]:
    """The terms of one query to look up, the sum that matters, and whether sums are scores."""
    order = np.lexsort((tid, df / np.maximum(w, 1e-300) ** 2))
    cost = np.cumsum(df[order])
    if first:  # the best sums alone matter
        return order[: max(1, int(np.searchsorted(cost, SEED, side="right")))], 0.0, True
    rests = tails(w[order], top[order])
    n = int(np.argmax(rests <= REST * floor))
    if floor <= 0 or n == 0 or cost[-1] <= CHEAP or cost[n - 1] >= WHOLE * cost[-1]:
        return order, max(floor - SLACK, 0.0), True
    return order[:n], max(floor - rests[n] - SLACK, 0.0), False


def below(least: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What matters in four bytes, never more than it is; negative where sums are not scores."""
    short = np.nextafter(least.astype(np.float32), np.float32(0))
    return np.where(whole, short, -short)


def lookups(first: bool, bits: int):
    """The terms that the blocks of ``2 ** bits`` queries look up, from rows sorted by block."""

    def grouped(table: pa.Table) -> pa.RecordBatch:
        qid, block = table.column("qid").to_numpy(), table.column("block").to_numpy()
        off, tid = lists(table.column("tid"))
        tid = tid.to_numpy()
        w, df, top = (lists(table.column(c))[1].to_numpy() for c in ("w", "df", "top"))
        floor = np.zeros(len(qid)) if first else table.column("floor").fill_null(0.0).to_numpy()
        at, least, whole, size = [np.zeros(0, np.int64)], [], [], []
        for r, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            some, need, full = chosen(tid[s:e], w[s:e], df[s:e], top[s:e], floor[r], first)
            at.append(some + s)
            least.append(need)
            whole.append(full)
            size.append(len(some))
        at, row = np.concatenate(at), np.repeat(np.arange(len(qid)), size)
        order = np.lexsort((tid[at], block[row]))
        at, row = at[order], row[order]
        edge = np.ones(len(at), bool)
        edge[1:] = (tid[at][1:] != tid[at][:-1]) | (block[row][1:] != block[row][:-1])
        edge = np.flatnonzero(edge)
        mine = np.empty(len(at), ASKED)
        mine["q"], mine["w"] = qid[row] & ((1 << bits) - 1), w[at]
        mine["least"] = below(np.array(least, float), np.array(whole, bool))[row]
        data = [pa.array(block[row[edge]]), pa.array(tid[at[edge]]), packed(mine, np.append(edge, len(at)))]
        return pa.record_batch(data, names=["block", "tid", "asked"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        # Some whole blocks at a time.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            last = int(np.searchsorted(block, block[-1]))
            if held and (last or held[-1].column("block")[-1].as_py() != block[0]):
                yield grouped(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield grouped(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield grouped(pa.Table.from_batches(held))

    return run


def tiles(batches) -> Iterator[pa.Table]:
    """Tables of the rows of one tile each, from batches sorted by ``block, range``."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "range")])
        edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(edge, edge[1:]):
            mine = tuple(keys[:, s].tolist())
            if held and mine != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = mine
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(table: pa.Table) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Each block of a tile, with the sums of its queries."""
    q_off, asked = unpacked(table.column("asked"), ASKED)
    q, w, least = asked["q"].astype(np.int32), asked["w"], asked["least"]
    c_off, c = lists(table.column("c"))
    rows = c_off, c.to_numpy().astype(np.int32), lists(table.column("cw"))[1].to_numpy()
    term, block = np.repeat(np.arange(table.num_rows), np.diff(q_off)), q >> BLOCK
    order = np.argsort(block, kind="stable")
    edge = np.searchsorted(block[order], np.arange(int(block.max(initial=0)) + 2))
    for n, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if s < e:
            at = order[s:e]
            off = np.r_[0, np.cumsum(np.bincount(term[at], minlength=table.num_rows))]
            yield n, sums(off, q[at] & ((1 << BLOCK) - 1), w[at], least[at], *rows)


def sums(q_off, ql, qw, least_, c_off, cl, cw) -> tuple[np.ndarray, ...]:
    """Queries and rows that share a term, their sums, and per query what matters and whether it is whole."""
    least, whole = np.full(1 << BLOCK, np.inf), np.zeros(1 << BLOCK, bool)
    least[ql], whole[ql] = np.abs(least_), ~np.signbit(least_)
    nq, nc = np.diff(q_off), np.diff(c_off)
    width = int(cl.max()) + 1
    cells = (1 << BLOCK) * width
    dense = int(nq @ nc) > cells // 16
    grid = np.zeros(cells) if dense else None
    # Terms with many products go through a matrix product, the others one by one.
    heavy = np.flatnonzero(dense & (nq * nc > width))
    step = max(1, CHUNK // width)
    for k in range(0, len(heavy), step):
        some = heavy[k : k + step]
        left, right = np.zeros((1 << BLOCK, len(some))), np.zeros((len(some), width))
        for m, t in enumerate(some.tolist()):
            a, b = slice(q_off[t], q_off[t + 1]), slice(c_off[t], c_off[t + 1])
            left[ql[a], m], right[m, cl[b]] = qw[a], cw[b]
        grid += (left @ right).ravel()
    # One line per query entry, and its row's list behind it.
    light = np.ones(len(nq), bool)
    light[heavy] = False
    line = np.repeat(np.flatnonzero(light), nq[light])
    entry = np.flatnonzero(np.repeat(light, nq))
    many = nc[line]
    total = np.r_[0, np.cumsum(many)]
    found, added, i = [], [], 0
    while i < len(line):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, side="right")) - 1)
        e = np.repeat(np.arange(i, j), many[i:j])
        at = c_off[line[e]] + np.arange(len(e)) - (total[e] - total[i])
        cell, value = ql[entry[e]].astype(np.int64) * width + cl[at], qw[entry[e]] * cw[at]
        if dense:
            low, high = int(cell.min()), int(cell.max()) + 1
            grid[low:high] += np.bincount(cell - low, value, minlength=high - low)
        else:
            found.append(cell)
            added.append(value)
        i = j
    if dense:
        cell = np.flatnonzero(grid)
        return *np.divmod(cell, width), grid[cell], least, whole
    cell, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
    return *np.divmod(cell, width), np.bincount(inverse, np.concatenate([np.zeros(0), *added]), minlength=len(cell)), least, whole


def best(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best of each group, ties to the smaller place."""
    order = np.lexsort((place, -score, group))
    ranked = group[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else order
    return order[np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)])) < k]


def candidates(k: int, bits: int):
    """Of every tile the rows that may be among their query's best ``k``: where sums
    are scores the tile's best ``k``, else all whose sum matters."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in tiles(batches):
            first, range_ = table.column("block")[0].as_py() << bits, table.column("range")[0].as_py() << RANGE
            for n, (q, c, score, least, whole) in blocks(table):
                keep = score >= least[q]
                q, c, score = q[keep], c[keep], score[keep]
                done = np.flatnonzero(whole[q])
                done = done[best(q[done], np.round(score[done], DIGITS), c[done], k)]
                at = np.concatenate([done, np.flatnonzero(~whole[q])])
                yield pa.record_batch(
                    [pa.array(first + (n << BLOCK) + q[at]), pa.array(range_ + c[at]), pa.array(score[at]), pa.array(whole[q[at]])],
                    names=["qid", "cid", "score", "whole"],
                )

    return run


def completed(batches) -> Iterator[pa.RecordBatch]:
    """Exact scores of the pairs of each tile, from the vectors of both sides."""
    for table in tiles(batches):
        block, range_ = table.column("block")[0].as_py(), table.column("range")[0].as_py()
        side = table.column("side").to_numpy()
        asked, rows = (table.filter(pa.array(side == s)) for s in (0, 1))
        q_off, q_tid = lists(asked.column("tid"))
        terms, q_term = np.unique(q_tid.to_numpy(), return_inverse=True)
        q_w = lists(asked.column("w"))[1].to_numpy()
        place = np.zeros(1 << BLOCK, np.int64)
        place[asked.column("place").to_numpy()] = np.arange(asked.num_rows)
        c_off, c_tid = lists(rows.column("tid"))
        c_tid, c_w = c_tid.to_numpy(), lists(rows.column("w"))[1].to_numpy()
        p_off, partner = lists(rows.column("partners"))
        partner, c_place = partner.to_numpy(), rows.column("place").to_numpy()
        weight = np.zeros(len(terms) + 1)
        out_q, out_c, out_s = [], [], []
        for r in range(rows.num_rows):
            s, e = c_off[r], c_off[r + 1]
            at = np.searchsorted(terms, c_tid[s:e])
            at[(at == len(terms)) | (terms[np.minimum(at, len(terms) - 1)] != c_tid[s:e])] = len(terms)
            weight[at] = c_w[s:e]
            for p in partner[p_off[r] : p_off[r + 1]].tolist():
                a, b = q_off[place[p]], q_off[place[p] + 1]
                out_q.append(p)
                out_c.append(c_place[r])
                out_s.append(q_w[a:b] @ weight[q_term[a:b]])
            weight[at] = 0
        yield pa.record_batch(
            [
                pa.array((block << BLOCK) + np.array(out_q, np.int64)), pa.array((range_ << RANGE) + np.array(out_c, np.int64)),
                pa.array(np.array(out_s, float)), pa.array(np.ones(len(out_q), bool)),
            ],
            names=["qid", "cid", "score", "whole"],
        )


# --- the search ---------------------------------------------------------------

def tiled(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over partitions that hold whole tiles of ``block`` and ``range``."""
    keys = ["block", "range"]
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def together(queries: int) -> int:
    """The power of two of queries that are shipped postings once."""
    return BLOCK + min(SPAN, max(1, queries // (TILES << BLOCK)).bit_length() - 1)


class Search:
    """One search of the numbered ``counts`` of queries in an index, step by step;
    ``bits`` tells how many queries are shipped postings together."""

    def __init__(self, counts: DataFrame, index: dict[str, DataFrame], k: int, bits: int | None = None):
        self.index, self.k, self.counts = index, k, counts
        self.bits = together(counts.count()) if bits is None else bits
        self.vectors = self.query_vectors()

    def query_vectors(self) -> DataFrame:
        """``qid`` and arrays of terms, weights, frequencies and largest weights."""
        asked = self.counts.select("qid", F.inline("counts")).join(self.index["terms"], "term")
        # A bound in four bytes, never less than it is.
        top = (F.col("top") * (1 + 1e-6)).cast("float").alias("top")
        raw = asked.select("qid", "tid", ((F.ln("tf") + 1) * F.col("idf")).alias("w"), F.col("df").cast("int").alias("df"), top)
        rows = unit(raw, "qid", F.struct("tid", "w", "df", "top"), ["tid", "df", "top"])
        return checkpoint(rows.withColumn("cost", F.aggregate("df", F.lit(0).cast("long"), lambda a, x: a + x)))

    def looked_up(self, queries: DataFrame, first: bool) -> DataFrame:
        """Candidates from the postings of some of each query's terms."""
        placed = queries.withColumn("block", F.shiftright("qid", self.bits)).repartition("block").sortWithinPartitions("block")
        asked = placed.mapInArrow(lookups(first, self.bits), LOOKUP)
        # Lists of numbers take less than half of lists of structs in a shuffle.
        rows = self.index["postings"].select("tid", "range", "rows")
        place = F.col("rows.c").cast("array<smallint>").alias("c")
        joined = asked.join(rows, "tid").select("block", "range", "asked", place, F.col("rows.w").alias("cw"))
        return tiled(joined, candidates(self.k, self.bits), FOUND)

    def floors(self) -> DataFrame:
        """``qid, floor``: at least the k-th score, where the first terms show one."""
        sums_ = self.looked_up(self.vectors.where(F.col("cost") > CHEAP), first=True)
        line = Window.partitionBy("qid").orderBy(F.desc("score"))
        kth = sums_.withColumn("n", F.row_number().over(line)).where(F.col("n") == self.k)
        return checkpoint(kth.select("qid", F.col("score").alias("floor")))

    def candidates(self) -> DataFrame:
        """``qid, cid, score, whole``: rows that may be among the best; ``whole`` if the score is."""
        if self.vectors.where(F.col("cost") > CHEAP).isEmpty():
            queries = self.vectors.withColumn("floor", F.lit(0.0))
        else:
            queries = self.vectors.join(self.floors(), "qid", "left")
        return checkpoint(self.looked_up(queries, first=False))

    def complete(self, pairs: DataFrame) -> DataFrame:
        """The scores of candidates whose sums are not whole."""
        local = lambda c, bits: F.col(c).bitwiseAND((1 << bits) - 1).cast("int")
        block, range_ = F.shiftright("qid", BLOCK).alias("block"), F.shiftright("cid", RANGE).alias("range")
        none = F.lit(None).cast("array<int>").alias("partners")
        asked = pairs.select("qid", range_).distinct().join(self.vectors, "qid").select(
            block, "range", F.lit(0).alias("side"), local("qid", BLOCK).alias("place"), "tid", "w", none
        )
        rows = pairs.groupBy(block, "cid").agg(F.collect_list(local("qid", BLOCK)).alias("partners"))
        rows = rows.join(self.index["vectors"], "cid").select(
            "block", range_, F.lit(1).alias("side"), local("cid", RANGE).alias("place"), "tid", "w", "partners"
        )
        return tiled(asked.union(rows), completed, FOUND)

    def scored(self) -> DataFrame:
        """``qid, cid, score`` of all that may be among the best."""
        found = self.candidates()
        pairs = found.where("not whole").select("qid", "cid")
        if not pairs.isEmpty():
            found = found.where("whole").union(self.complete(pairs))
        return found.select("qid", "cid", F.round("score", DIGITS).alias("score"))


def best_found(counts: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    """``qid, cid, score`` of the ``k`` best rows of each query that share a term with
    it, written; the blocks of queries are searched in ``WAVES`` at most."""
    queries = counts.count()
    bits = together(queries)
    tiles_ = max(1, queries >> bits) * max(1, index["docs"].count() >> RANGE)
    waves = max(1, min(WAVES, tiles_ // TILES))
    line = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = None
    for wave in range(waves):
        # Whole blocks go to a wave.
        mine = F.pmod(F.xxhash64(F.shiftright("qid", bits)), F.lit(waves)) == wave
        search = Search(counts.where(mine) if waves > 1 else counts, index, k, bits)
        ranked = search.scored().where("score > 0").withColumn("n", F.row_number().over(line))
        part = checkpoint(ranked.where(F.col("n") <= k).drop("n"))
        discard(search.vectors)
        found = part if found is None else found.union(part)
    return found


def top_k(
    counts: DataFrame,
    index: dict[str, DataFrame],
    k: int = fixed.TOP_K,
    exclude_self: bool = False,
    min_similarity: float = 0.0,
) -> DataFrame:
    """``(query_id, rank, corpus_id, similarity)`` of the k best rows of the corpus.

    ``counts`` has the queries' ``query_id``, number ``qid`` and term counts; of
    these and of the index, the hits read nothing again but ``docs``.

    Ties go to the smaller id; where fewer than k rows share a term with a
    query, rows of smallest id follow with similarity 0.  Ranks are set before
    ``min_similarity`` is applied.
    """
    most = k + int(exclude_self)
    found = best_found(counts, index, most)
    docs, names = index["docs"], checkpoint(counts.select("qid", "query_id"))
    if min_similarity <= 0:
        # The rows of smallest id for queries that too few rows answer.
        firsts = [r.cid for r in docs.orderBy("cid").limit(most).collect()]
        full = found.groupBy("qid").count().where(F.col("count") >= most).select("qid")
        short = names.select("qid").join(full, "qid", "left_anti")
        blank = short.select("qid", F.explode(F.array(*[F.lit(c) for c in firsts]).cast("array<bigint>")).alias("cid"), F.lit(0.0).alias("score"))
        found = found.union(blank.join(found.select("qid", "cid"), ["qid", "cid"], "left_anti"))
    # Ranked by number first: numbers rise with ids.
    line = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("n", F.row_number().over(line)).where(F.col("n") <= most).drop("n")
    named = found.join(names, "qid").join(docs, "cid")
    if exclude_self:
        named = named.where("query_id != corpus_id")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    ranked = named.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return ranked.where(F.col("score") >= min_similarity).select("query_id", "rank", "corpus_id", F.col("score").alias("similarity"))
