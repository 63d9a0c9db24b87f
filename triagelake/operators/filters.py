"""Row filters for training sets and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators.rows import fresh

# Labels folded into one pattern; more are looked up by their words.
PATTERN_LABELS = 1000
WORD = r"[\p{L}\p{N}_]+"


def one_scheme(df: DataFrame, scheme: str) -> DataFrame:
    return df.where(F.col("trainable_category") & (F.col("category_scheme") == scheme))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def min_class(df: DataFrame, label: str, size: int = fixed.MIN_CLASS_SIZE) -> DataFrame:
    """Rows whose class has at least ``size`` rows."""
    large = class_sizes(df, label).where(F.col("n") >= size).select(label)
    return df.join(large, label, "left_semi")


def min_class_report(df: DataFrame, label: str, size: int = fixed.MIN_CLASS_SIZE) -> DataFrame:
    large = F.col("n") >= size
    return class_sizes(df, label).agg(
        F.sum(large.cast("long")).alias("classes_kept"),
        F.sum(F.when(large, 0).otherwise(F.col("n"))).alias("rows_dropped"),
    )


def min_words(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(text.word_count(F.col(column)) >= n)


def strip_labels(
    df: DataFrame, column: str, label: str, pattern_labels: int = PATTERN_LABELS
) -> DataFrame:
    """Remove every known label, with any ``-<number>``, from the text.

    Up to ``pattern_labels`` labels become one pattern.  Beyond, a text's words
    fetch the labels that may stand in it, and they alone make its pattern,
    which removes the same.
    """
    known = df.select(F.col(label).cast("string").alias("label")).where("label is not null").distinct()
    labels = [r[0] for r in known.limit(pattern_labels + 1).collect()]
    if len(labels) > pattern_labels:
        return _strip_fetched(df, column, known)
    if not labels:
        return df.withColumn(column, text.squeeze(F.col(column)))
    pattern = text.label_pattern(labels)
    return df.withColumn(column, text.strip_pattern(F.col(column), pattern))


def _strip_fetched(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``strip_labels`` for any number of labels, by a join on words.

    A label that stands in a text at word boundaries has its first word there
    as a whole word.  Labels without a word are fetched by every text.
    """
    words = F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))
    texts = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    texts = texts.select(F.sha2(column, 256).alias("text"), words.alias("words"))
    asked = texts.select("text", F.explode(F.array_append(F.array_distinct("words"), "")).alias("word"))
    filed = known.select("label", F.lower(F.regexp_extract("label", WORD, 0)).alias("word"))
    escaped = F.regexp_replace("label", r"([^\p{L}\p{N}_\s])", r"\\$1")
    fetched = asked.join(filed, "word").select("text", F.struct(-F.length("label"), "label", escaped.alias("e")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set("l")), lambda x: x["e"]), "|")
    digest = fresh("text", df.columns)
    pattern = fresh("pattern", [*df.columns, digest])
    patterns = fetched.groupBy(F.col("text").alias(digest)).agg(
        F.concat(F.lit(r"(?iU)\b(?:"), body, F.lit(r")(?:-\d+)?\b")).alias(pattern)
    )
    rows = df.withColumn(digest, F.sha2(column, 256)).join(patterns, digest, "left")
    cut = F.regexp_replace(F.col(column), F.coalesce(pattern, F.lit(r"(?!)")), F.lit(" "))
    return rows.withColumn(column, text.squeeze(cut)).select(*df.columns)


def keep_first_text(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per normalised text: the one with the smallest id.

    A text may repeat very often, so the smallest id per text hash is found
    by partial aggregation, and the rows are picked by a semi join on it.
    """
    first = df.groupBy(text.text_hash(F.col(column))).agg(F.min(key).alias(key))
    return df.join(first.select(key), key, "left_semi")
