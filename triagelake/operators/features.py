"""Terms, TF-IDF weights and class weights as DataFrames.

Weights follow the smoothed form: tf ``1 + ln(tf)``, idf
``ln((1 + n) / (1 + df)) + 1``, rows scaled to unit length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import fixed, text
from triagelake.operators.rows import settle
from triagelake.session import checkpoint


# Rows of a batch whose terms are counted at a time.
COUNTED = 512
# Of the 64-bit hash that Spark gives a string.
XX_SEED = 42
XX_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
# A vocabulary capped to at most this many terms may be broadcast.
BROADCAST_TERMS = 100_000


def with_terms(
    df: DataFrame,
    column: str,
    ngrams: tuple[int, int] = (1, 1),
    stop_words=fixed.STOP_WORDS,
    out: str = "terms",
) -> DataFrame:
    """Add the terms of a text; bigrams join words left after stop words."""
    df = settle(df, _t=text.tokens(F.col(column), stop_words))
    terms = F.col("_t")
    if ngrams == (1, 2):
        heads = F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0)))
        pairs = F.transform(
            heads, lambda w, i: F.concat(w, F.lit(" "), F.get("_t", i + 1))
        )
        terms = F.concat(terms, pairs)
    elif ngrams != (1, 1):
        raise ValueError("ngrams must be (1, 1) or (1, 2)")
    return df.withColumn(out, terms).drop("_t")


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``(key, counts array<struct<term, tf>>)``.

    Terms are counted inside the scan, on Arrow batches; array expressions do
    the same at several times the cost.
    """
    rows = df.select(key, terms)
    count = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = T.StructType([rows.schema[key], T.StructField("counts", T.ArrayType(count))])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(start, COUNTED)
                lists = batch.column(terms)
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
                words = lists.flatten().dictionary_encode()
                kinds = max(1, len(words.dictionary))
                row = np.repeat(np.arange(batch.num_rows), sizes)
                cell, tf = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(cell, kinds)
                counted = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), pa.array(tf)], names=["term", "tf"])
                bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.record_batch([batch.column(key), pa.ListArray.from_arrays(bounds, counted)], names=[key, "counts"])

    return rows.mapInArrow(run, schema)


def xxhash64(terms: pa.Array) -> np.ndarray:
    """``F.xxhash64`` of strings, those of one length at a time."""
    old = np.seterr(over="ignore")
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    size, out = np.diff(ends), np.empty(len(terms), np.uint64)
    order = np.argsort(size.astype(np.uint16) if size.max(initial=0) < 1 << 16 else size, kind="stable")
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in XX_PRIMES)
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    edge = np.flatnonzero(np.diff(size[order], prepend=-1))
    for at in np.split(order, edge[1:]) if len(order) else ():
        n = int(size[at[0]])
        rows = np.lib.stride_tricks.sliding_window_view(data, n)[ends[at]] if n else np.zeros((len(at), 0), np.uint8)
        word = lambda i, kind: np.ascontiguousarray(rows[:, i : i + kind.itemsize]).view(kind)[:, 0].astype(np.uint64)  # noqa: B023, E731
        mixed = lambda k: turned(k * p2, 31) * p1
        h, i = np.full(len(at), XX_SEED, np.uint64) + p5, 0
        if n >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (p1 + p2 + np.uint64(XX_SEED), p2 + np.uint64(XX_SEED), np.uint64(XX_SEED), np.uint64(XX_SEED) - p1)]
            while i + 32 <= n:
                v = [turned(x + word(i + 8 * j, np.dtype("<u8")) * p2, 31) * p1 for j, x in enumerate(v)]
                i += 32
            h = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
            for x in v:
                h = (h ^ mixed(x)) * p1 + p4
        h = h + np.uint64(n)
        while i + 8 <= n:
            h = turned(h ^ mixed(word(i, np.dtype("<u8"))), 27) * p1 + p4
            i += 8
        if i + 4 <= n:
            h = turned(h ^ (word(i, np.dtype("<u4")) * p1), 23) * p2 + p3
            i += 4
        for j in range(i, n):
            h = turned(h ^ (rows[:, j].astype(np.uint64) * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[at] = h ^ (h >> np.uint64(32))
    np.seterr(**old)
    return out.view(np.int64)


def byted(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers as bytes, one value per row; as lists they would be handled one by one on their way."""
    ends = (np.asarray(bounds) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def numbers(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows' numbers in a column of ``byted``, and the numbers."""
    kind = np.dtype(kind)
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for c in chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset).astype(np.int64)
            sizes.append(np.diff(ends) // kind.itemsize)
            if ends[-1] > ends[0]:
                values.append(np.frombuffer(c.buffers()[2], kind, int(ends[-1] - ends[0]) // kind.itemsize, int(ends[0])))
    return np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(values) if len(values) != 2 else values[1]


def as_bytes(df: DataFrame) -> DataFrame:
    """The lists ``h`` and ``tf`` as bytes, like those of ``hashed_terms``."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in ("h", "tf") else f for f in df.schema])

    def run(batches):
        for batch in batches:
            columns = []
            for name in batch.schema.names:
                lists = batch.column(name)
                if name in ("h", "tf"):
                    bounds = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))
                    lists = byted(lists.flatten().to_numpy(zero_copy_only=False), bounds)
                columns.append(lists)
            yield pa.record_batch(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def hashed_terms(
    df: DataFrame, key: str, column: str, ngrams: tuple[int, int] = (1, 2), stop_words=fixed.STOP_WORDS
) -> DataFrame:
    """``(key, h binary, tf binary)``: ``F.xxhash64`` of a text's distinct terms, eight
    bytes each, and how often they occur, four bytes each.

    The same terms as ``term_counts`` of ``with_terms``, where only hashes are
    needed: words alone reach the task, and a pair is spelled once per batch.
    """
    if ngrams not in ((1, 1), (1, 2)):
        raise ValueError("ngrams must be (1, 1) or (1, 2)")
    rows = df.select(key, text.tokens(F.col(column), stop_words).alias("_t"))
    schema = T.StructType([rows.schema[key], T.StructField("h", T.BinaryType()), T.StructField("tf", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(start, COUNTED)
                n, lists = batch.num_rows, batch.column("_t")
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
                words = lists.flatten().dictionary_encode()
                names, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
                row, kinds = np.repeat(np.arange(n), sizes), max(1, len(words.dictionary))
                cell, tf = np.unique(word * n + row, return_counts=True)
                word_, row_ = np.divmod(cell, n)
                h = xxhash64(names)[word_]
                if ngrams == (1, 2) and len(word) > 1:
                    near = np.flatnonzero(row[1:] == row[:-1])
                    cell, tf2 = np.unique((word[near] * kinds + word[near + 1]) * n + row[near], return_counts=True)
                    pair, row2 = np.divmod(cell, n)
                    first = np.flatnonzero(np.diff(pair, prepend=-1))
                    a, b = (names.take(pa.array(x)) for x in np.divmod(pair[first], kinds))
                    h2 = np.repeat(xxhash64(pc.binary_join_element_wise(a, b, " ")), np.diff(np.append(first, len(pair))))
                    h, row_, tf = np.append(h, h2), np.append(row_, row2), np.append(tf, tf2)
                order = np.argsort(row_.astype(np.uint16), kind="stable")
                bounds = np.append(0, np.cumsum(np.bincount(row_, minlength=n)))
                data = [batch.column(key), byted(h[order], bounds), byted(tf[order].astype(np.int32), bounds)]
                yield pa.record_batch(data, names=[key, "h", "tf"])

    return rows.mapInArrow(run, schema)


def vocabulary(
    counts: DataFrame, docs: DataFrame, min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """``(term, df, cf, idf)`` of the term counts of ``docs``.

    ``max_features`` keeps the terms most frequent in the corpus, ties by
    term.
    """
    # Counted on the documents themselves, which reads no text.
    n = docs.agg(F.count("*")).scalar()
    terms = (
        counts.select(F.inline("counts"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .where(F.col("df") >= min_df)
    )
    if max_features is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    return terms.withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1)


def weigh(
    counts: DataFrame,
    terms: DataFrame,
    key: str,
    sublinear: bool = True,
    by: str = "term",
    keys: DataFrame | None = None,
    keep: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """``(key, terms array, weights array<double>)``, unit length.

    One row per document, entries in the order of ``by`` (the term or its
    index).  Documents without a known term have no row, unless ``keys``
    lists the documents that must have one.  ``keep`` names a flag of
    ``terms``: all terms count for the length, only flagged ones are kept.
    """
    # The planner sizes exploded terms like the row they came from and would
    # broadcast them; the hint shuffles both sides and hashes the vocabulary,
    # so exploded terms are not sorted, and AQE splits frequent ones.  Only a
    # vocabulary capped to a few terms is broadcast.
    exploded = counts.select(key, F.inline("counts"))
    flag = F.lit(True) if keep is None else F.col(keep)
    known = terms.select("term", "idf", flag.alias("_keep"), *([by] if by != "term" else []))
    tf = F.ln(F.col("tf")) + 1 if sublinear else F.col("tf")
    known = F.broadcast(known) if bounded else known.hint("shuffle_hash")
    raw = exploded.join(known, "term").select(
        key, F.col(by).alias("t"), (tf * F.col("idf")).alias("w"), "_keep"
    )
    if keys is not None:
        nothing = [
            F.lit(None).cast(raw.schema[c].dataType).alias(c) for c in ("t", "w", "_keep")
        ]
        raw = raw.unionByName(keys.select(key, *nothing))
    entry = F.when(F.col("_keep"), F.struct("t", "w"))
    rows = raw.groupBy(key).agg(
        F.sort_array(F.collect_list(entry)).alias("e"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    return rows.select(
        key,
        F.transform("e", lambda x: x["t"]).alias("terms"),
        F.transform("e", lambda x: x["w"] / F.col("_norm")).alias("weights"),
    )


def long_weights(vectors: DataFrame, key: str) -> DataFrame:
    """``(key, term, weight)`` rows."""
    pairs = F.inline(F.arrays_zip("terms", "weights"))
    return vectors.select(key, pairs).toDF(key, "term", "weight")


def tfidf(
    df: DataFrame,
    key: str,
    column: str,
    ngrams: tuple[int, int] = (1, 2),
    min_df: int = 1,
    max_features: int | None = None,
    sublinear: bool = True,
    stop_words=fixed.STOP_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Vectors of the documents, and the vocabulary to weigh others with."""
    counts = checkpoint(term_counts(with_terms(df, column, ngrams, stop_words), key))
    terms = vocabulary(counts, counts, min_df, max_features)
    bounded = max_features is not None and max_features <= BROADCAST_TERMS
    rows = weigh(counts, terms, key, sublinear, keys=counts.select(key), bounded=bounded)
    return rows, terms


def tfidf_queries(
    df: DataFrame,
    key: str,
    column: str,
    terms: DataFrame,
    ngrams: tuple[int, int] = (1, 2),
    sublinear: bool = True,
    stop_words=fixed.STOP_WORDS,
) -> DataFrame:
    """Vectors of new texts under an existing vocabulary."""
    counts = term_counts(with_terms(df, column, ngrams, stop_words), key)
    # The terms asked for are written first, so that their measured size
    # decides how they are looked up in the vocabulary.
    known = terms.join(asked_terms(counts), "term", "left_semi")
    return weigh(counts, known, key, sublinear, keys=df.select(key))


def asked_terms(counts: DataFrame) -> DataFrame:
    """Distinct terms of some texts, as a table of known size."""
    return checkpoint(counts.select(F.inline("counts")).select("term").distinct())


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    classes = sizes.agg(F.count("*")).scalar()
    return sizes.withColumn("class_weight", total / (classes * F.col("n")))
