"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Words and their shapes (runs of capitals, small letters and digits folded,
other characters kept) give uni- and bigrams, and a word equal to the one
before gives a feature of its own.  Features are hashed into ``2 ** BITS``
weights; a text's value of a feature is its share of the text's n-grams of
that sort.  Tasks train on parts of the labelled sample and their weights are
averaged; scoring is a sparse dot product inside the scan.

Defined results: NULL and empty texts score by the bias alone; ties cannot
arise; repeated rows score alike; labels that are NULL or lack a text are not
used; without labels of both classes every score is 0.5; columns named like
the added ones are replaced by them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.arrow import BYTE, mix, pieces, range_hashes, record_batches, tidy, utf8, words
from triagelake.llm.names import fresh
from triagelake.session import checkpoint

BITS = 18
# At most so many labelled rows are fitted on, the least by a hash of the id.
SAMPLE = 20_000
PART = 5_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = ord("a")
KIND[ord("A") : ord("Z") + 1] = ord("A")
KIND[ord("0") : ord("9") + 1] = ord("0")
KIND[128:] = ord("a")


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))


def features(data, off, i, j):
    """Row, index and value arrays of the n-grams of rows ``i`` to ``j``."""
    plain, cut, buf, start, end = words(data, off, i, j, lower=False)
    n = len(plain)
    row = np.repeat(np.arange(j - i), np.diff(cut))
    kinds = KIND[buf]
    first = np.ones(len(kinds), bool)
    first[1:] = (kinds[1:] != kinds[:-1]) | ~np.isin(kinds[1:], (ord("a"), ord("A"), ord("0")))
    if n:
        first[start] = True
    at = np.r_[0, np.cumsum(first)]
    shape = range_hashes(BYTE[kinds[first]], at[start], at[end]) if n else plain
    pair = row[1:] == row[:-1]
    sorts = [
        (row, salted(plain, 1)),
        (row, salted(shape, 2)),
        (row[1:][pair], salted(plain[:-1] * np.uint64(3) + plain[1:], 3)[pair]),
        (row[1:][pair], salted(shape[:-1] * np.uint64(5) + shape[1:], 4)[pair]),
        (row[1:][pair], np.where(plain[1:] == plain[:-1], np.uint64(11), np.uint64(13))[pair]),
    ]
    rows, index, value = [], [], []
    for r, h in sorts:
        count = np.bincount(r, minlength=j - i)
        rows.append(r)
        index.append((h & np.uint64((1 << BITS) - 1)).astype(np.int64))
        value.append((1.0 / np.maximum(count, 1))[r])
    return np.concatenate(rows), np.concatenate(index), np.concatenate(value)


def fit_part(batches):
    """FTRL-proximal over one part's rows; yields its nonzero weights.

    The part is bounded by ``SAMPLE``; it holds sparse features, not texts.
    """
    examples = []
    for batch in record_batches(batches):
        data, off = utf8(batch.column("text"))
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for i, j in pieces(off):
            r, x, v = features(data, off, i, j)
            order = np.argsort(r, kind="stable")
            r, x, v = r[order], x[order], v[order]
            cut = np.searchsorted(r, np.arange(j - i + 1))
            for k in range(j - i):
                u, inv = np.unique(x[cut[k] : cut[k + 1]], return_inverse=True)
                examples.append((u.astype(np.int32), np.bincount(inv, v[cut[k] : cut[k + 1]], len(u)).astype(np.float32), float(target[i + k])))
    if not examples:
        return
    share = np.mean([e[2] for e in examples])
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(5)
    w = np.zeros((1 << BITS) + 1)
    if 0 < share < 1:
        for _ in range(EPOCHS):
            for k in rng.permutation(len(examples)):
                x, v, y = examples[k]
                x, v = np.r_[x, 1 << BITS], np.r_[v, 0.2]
                zx, nx = z[x], n[x]
                wx = np.where(np.abs(zx) <= L1, 0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
                p = 1 / (1 + np.exp(-np.clip(wx @ v, -35, 35)))
                g = (p - y) * v * (0.5 / (share if y else 1 - share))
                s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
                z[x] += g - s * wx
                n[x] += g * g
        w = np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["index", "weight"])


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights, the bias last, from at most ``sample`` labelled rows.

    Rows are taken in the order of a hash of the id; the id sets are bounded
    by ``sample`` and so may be broadcast.  A task fits about ``PART`` of them.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("target"))
    known = known.orderBy(F.xxhash64(F.lit(3), key), key).limit(sample)
    known = checkpoint(known)
    tasks = max(1, -(-known.count() // PART))
    rows = documents.select(key, text).join(F.broadcast(known), key)
    part = F.pmod(F.xxhash64(F.lit(4), key), F.lit(tasks))
    parts = rows.select(F.col(text).alias("text"), "target", part.alias("part"))
    parts = parts.repartitionById(tasks, F.col("part").cast("int")).sortWithinPartitions("text", "target")
    found = parts.drop("part").mapInArrow(tidy(fit_part), "index long, weight double")
    mean = found.groupBy("index").agg((F.sum("weight") / tasks).alias("weight")).collect()
    weights = np.zeros((1 << BITS) + 1)
    for r in mean:
        weights[r["index"]] = r["weight"]
    return weights


def score(df: DataFrame, weights: np.ndarray, text: str = "text", keep=()) -> DataFrame:
    """The columns ``keep`` and ``score``, the probability of label 1."""
    body = fresh("_text", list(keep))
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = model.value
        for batch in record_batches(batches):
            data, off = utf8(batch.column(body))
            total = np.full(batch.num_rows, 0.2 * float(w[-1]))
            for i, j in pieces(off):
                r, x, v = features(data, off, i, j)
                total[i:j] += np.bincount(r, w[x] * v, j - i)
            columns = [batch.column(c) for c in keep]
            yield pa.record_batch([*columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*keep, "score"])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    return df.select(*keep, F.col(text).alias(body)).mapInArrow(tidy(run), schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_mod(key) -> int:
    return zlib.crc32(str(key).encode()) % 5
