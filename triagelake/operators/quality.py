"""Boilerplate mining and the content left in resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators.rows import fresh, settle
from triagelake.session import checkpoint

# Boilerplate keys held as one constant inside a task; more than this are
# joined instead.
INLINE_KEYS = 2000


def first_sentences(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the first sentence ``s`` per key ``k``, in order; those without a key go."""
    keyed = F.transform(
        text.sentences(F.col(column)),
        lambda s, i: F.struct(text.sentence_key(s).alias("k"), i.alias("pos"), s.alias("s")),
    )
    rank = fresh("_sorted", [*df.columns, out])
    df = settle(df, **{rank: F.sort_array(keyed)})
    runs = F.filter(
        F.col(rank),
        lambda e, i: (e["k"] != "") & ((i == 0) | (F.get(rank, i - 1)["k"] != e["k"])),
    )
    ordered = F.transform(runs, lambda e: F.struct(e["pos"], e["k"].alias("k"), e["s"].alias("s")))
    return settle(df, **{out: F.sort_array(ordered)}).drop(rank)


def dedupe_sentences(df: DataFrame, column: str, out: str, sep: str = " ") -> DataFrame:
    """Keep the first sentence per key; sentences without a key go."""
    return first_sentences(df, column, out).withColumn(out, F.array_join(F.col(f"{out}.s"), sep))


def boilerplate(
    df: DataFrame, column: str, threshold: float = fixed.SENTENCE_SHARE
) -> DataFrame:
    """Sentence keys found in at least ``threshold`` of all documents.

    A document counts a key once: repeats are removed inside the row, and
    counts are combined before the shuffle.
    """
    keys = F.array_distinct(
        F.transform(
            text.sentences(F.col(column)), lambda s: text.sentence_key(text.trim_edges(s))
        )
    )
    total = df.agg(F.count("*")).scalar()
    counts = (
        df.select(F.explode(keys).alias("key"))
        .where(F.col("key") != "")
        .groupBy("key")
        .agg(F.count("*").alias("docs"))
    )
    shares = counts.withColumn("share", F.col("docs") / total)
    return shares.where(F.col("share") >= threshold)


def top_boilerplate(found: DataFrame, limit: int = 20) -> DataFrame:
    return found.orderBy(F.desc("share"), "key").limit(limit)


def extract_content(
    df: DataFrame,
    column: str,
    found: DataFrame,
    strict: bool = False,
    min_words: int = fixed.MIN_SENTENCE_WORDS,
    inline_keys: int = INLINE_KEYS,
) -> DataFrame:
    """Add ``resolution_content`` and ``content_words``.

    By default the drop test uses the untrimmed sentence key and repeated
    sentences are joined with a space before splitting again, so a sentence
    with a greeting in front of boilerplate survives and unpunctuated turns
    fuse.  ``strict`` trims before the test and keeps line breaks.

    The boilerplate keys number at most (mean distinct sentences per
    document) / threshold.  Up to ``inline_keys`` they travel as a constant
    and no text is shuffled; beyond that they are joined.  Rows are told apart
    by a number of their own, so ``key`` may repeat or be NULL, and the
    result is the same on both ways.
    """
    found = checkpoint(found.select("key"))
    known = [r.key for r in found.limit(inline_keys + 1).collect()]
    body, row, probed = (fresh(n, df.columns) for n in ("_text", "_row", "_probe"))
    single = first_sentences(df, column, body)

    def split_again(part) -> Column:
        # Sentences hold no line break, and once joined are parted behind the same
        # marks as before; keys of those that fuse are joined like these.
        ended = lambda e: F.lit(strict) | F.right(e["s"], F.lit(1)).isin(".", "!", "?")
        glued = F.transform(body, lambda e: F.concat(part(e), F.when(ended(e), "\n").otherwise(" ")))
        return F.split(F.btrim(F.array_join(glued, ""), F.lit(" \n")), "\n")

    def probe(e: Column) -> Column:
        return text.sentence_key(text.trim_edges(e["s"])) if strict else e["k"]

    spoken = F.zip_with(
        split_again(lambda e: e["s"]), split_again(probe), lambda s, k: F.struct(s.alias("s"), k.alias("k"))
    )
    if len(known) <= inline_keys:
        kept = F.filter(spoken, lambda e: ~e["k"].isin(known)) if known else spoken
        worded = F.transform(kept, lambda e: text.trim_edges(e["s"]))
        worded = F.transform(worded, lambda s: F.struct(text.word_count(s).alias("n"), s.alias("s")))
        done = settle(single, **{probed: F.filter(worded, lambda e: e["n"] >= min_words)})
    else:
        single = checkpoint(single.withColumn(row, F.monotonically_increasing_id()))
        exploded = single.select(F.col(row), F.posexplode(spoken).alias("pos", "e"))
        exploded = exploded.select(row, "pos", "e.s", F.col("e.k").alias(probed))
        left = exploded.join(found.withColumnRenamed("key", probed), probed, "left_anti")
        left = settle(left.select(row, "pos", text.trim_edges(F.col("s")).alias("s")), n=text.word_count(F.col("s")))
        ordered = F.sort_array(F.collect_list(F.struct("pos", "n", "s")))
        per_row = left.where(F.col("n") >= min_words).groupBy(row).agg(ordered.alias(probed))
        done = single.join(per_row, row, "left").drop(row)
    content = F.coalesce(F.array_join(F.col(f"{probed}.s"), " "), F.lit(""))
    words = F.aggregate(F.col(f"{probed}.n"), F.lit(0).cast("long"), lambda a, n: a + n)
    out = [c for c in df.columns if c not in ("resolution_content", "content_words")]
    return done.select(
        *out, content.alias("resolution_content"), F.coalesce(words, F.lit(0)).cast("long").alias("content_words")
    )


def content_floors(
    df: DataFrame, original: str, content: str, floors=fixed.CONTENT_FLOORS
) -> DataFrame:
    """Rows that keep at least each number of words; share of text removed."""
    n = F.col(content)
    wide = df.agg(
        F.count("*").alias("rows"),
        F.sum(original).alias("before"),
        F.sum(n).alias("after"),
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("floor"),
                    F.sum((n >= f).cast("long")).alias("kept"),
                )
                for f in floors
            ]
        ).alias("floors"),
    )
    removed = F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("after"), F.col("before")))
    return wide.select("*", F.inline("floors")).select(
        "floor", "kept",
        F.round(F.lit(100.0) * F.col("kept") / F.col("rows"), 4).alias("kept_pct"),
        F.round(removed, 4).alias("removed_pct"),
    )
