"""Profiles and reports over a ticket table, each as one small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import fixed, text
from triagelake.operators.cleaning import is_placeholder

FLAGS = (
    "has_description",
    "has_usable_resolution",
    "trainable_category",
    "trainable_priority",
    "retrievable",
)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    if not keep_null:
        df = df.where(F.col(column).isNotNull())
    return df.groupBy(column).agg(F.count("*").alias("n"))


def column_profile(
    df: DataFrame,
    tokens=fixed.PROFILE_MISSING_TOKENS,
    samples: int = 5,
    approximate: bool = False,
) -> DataFrame:
    """One row per column: type, missing, placeholders, distinct, zeros,
    sample values.

    Cells are turned into (column, value) rows and counted by value, which
    combines repeated values before the shuffle and gives every figure from
    one pass.  ``approximate`` avoids the shuffle: a single aggregation with
    sketches for the distinct count and no samples.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    dtype = F.create_map(*[F.lit(x) for n, t in types.items() for x in (n, t.simpleString())])
    textual = [n for n, t in types.items() if isinstance(t, T.StringType)]
    numeric = [n for n, t in types.items() if isinstance(t, T.NumericType)]
    if approximate:
        return _approximate_profile(df, types, tokens)
    is_text = F.col("column").isin(*textual) if textual else F.lit(False)
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    cells = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "value"
    )
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull()
    zero = is_number & (F.col("value").try_cast("double") == 0)
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("missing_count"),
        F.sum(
            F.when(is_text & is_placeholder(F.col("value"), tokens), F.col("n")).otherwise(0)
        ).alias("semantic_missing_count"),
        F.sum(filled.cast("long")).alias("unique_values"),
        F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("zero_count"),
    )
    smallest = Window.partitionBy("column").orderBy("value")
    shown = (
        counts.where(filled)
        .withColumn("rn", F.row_number().over(smallest))
        .where(F.col("rn") <= samples)
        .groupBy("column")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rn", "value"))),
                    lambda s: s["value"],
                ),
                " | ",
            ).alias("sample_values")
        )
    )
    return _profile_rates(
        per_column.join(shown, "column", "left").withColumn("dtype", dtype[F.col("column")])
    )


def _approximate_profile(df: DataFrame, types, tokens) -> DataFrame:
    figures = []
    for name, kind in types.items():
        c = F.col(name)
        zero = F.sum((c == 0).cast("long")) if isinstance(kind, T.NumericType) else F.lit(0)
        placeholder = (
            F.sum(is_placeholder(c, tokens).cast("long"))
            if isinstance(kind, T.StringType)
            else F.lit(0)
        )
        figures.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind.simpleString()).alias("dtype"),
                F.count("*").alias("rows"),
                F.sum(c.isNull().cast("long")).alias("missing_count"),
                F.coalesce(placeholder, F.lit(0)).cast("long").alias("semantic_missing_count"),
                F.approx_count_distinct(c).alias("unique_values"),
                F.coalesce(zero, F.lit(0)).cast("long").alias("zero_count"),
                F.lit(None).cast("string").alias("sample_values"),
            )
        )
    return _profile_rates(df.agg(F.inline(F.array(*figures))))


def _profile_rates(df: DataFrame) -> DataFrame:
    effective = F.col("missing_count") + F.col("semantic_missing_count")
    return df.select(
        "column",
        "dtype",
        "rows",
        "missing_count",
        percent(F.col("missing_count"), F.col("rows")).alias("missing_percent"),
        "semantic_missing_count",
        percent(F.col("semantic_missing_count"), F.col("rows")).alias("semantic_missing_percent"),
        "unique_values",
        "zero_count",
        F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        effective.alias("effective_missing_count"),
        percent(effective, F.col("rows")).alias("effective_missing_percent"),
    )


def top_missing(profile: DataFrame, limit: int = 15) -> DataFrame:
    """Columns with the largest effective missing share."""
    return (
        profile.select(
            "column", "missing_percent", "semantic_missing_percent",
            "effective_missing_percent", "unique_values",
        )
        .orderBy(F.desc("effective_missing_percent"), "column")
        .limit(limit)
    )


def missing_values(df: DataFrame) -> DataFrame:
    """NULL count and share of every column that has any."""
    totals = df.agg(
        F.count("*").alias("_rows"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns],
    )
    cells = totals.unpivot(["_rows"], df.columns, "column", "missing")
    return cells.where("missing > 0").select(
        "column", "missing", percent(F.col("missing"), F.col("_rows")).alias("missing_pct")
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, flag counts and shares, per source and over all sources."""
    per_source = df.groupBy("source").agg(
        F.count("*").alias("rows"),
        *[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS],
    )
    # The sources are few; the totals reuse their counts.
    totals = per_source.agg(
        F.lit("all").alias("source"), *[F.sum(c).alias(c) for c in ("rows", *FLAGS)]
    )
    both = per_source.unionByName(totals)
    return both.select(
        "*", *[percent(F.col(f), F.col("rows")).alias(f"{f}_pct") for f in FLAGS]
    )


def category_counts(df: DataFrame) -> DataFrame:
    """Rows per scheme and category of the trainable rows."""
    rows = df.where("trainable_category")
    return rows.groupBy(F.col("category_scheme").alias("scheme"), "category").agg(
        F.count("*").alias("n")
    )


def top_classes(counts: DataFrame, limit: int = 10) -> DataFrame:
    largest = Window.partitionBy("scheme").orderBy(F.desc("n"), "category")
    ranked = counts.withColumn("rank", F.row_number().over(largest))
    return ranked.where(F.col("rank") <= limit)


def class_balance(counts: DataFrame, top: int = 10) -> DataFrame:
    """Per scheme: rows, classes, largest and smallest class, imbalance
    ratio, share of rows in the ``top`` largest classes."""
    first = F.struct(-F.col("n"), "category")
    last = F.struct("n", "category")
    per_scheme = counts.groupBy("scheme").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("classes"),
        F.max("n").alias("largest"),
        F.min_by("category", first).alias("largest_class"),
        F.min("n").alias("smallest"),
        F.min_by("category", last).alias("smallest_class"),
    )
    held = top_classes(counts, top).groupBy("scheme").agg(F.sum("n").alias("held"))
    return per_scheme.join(held, "scheme").select(
        "scheme", "rows", "classes", "largest", "largest_class", "smallest",
        "smallest_class",
        F.round(F.col("largest") / F.col("smallest"), 4).alias("imbalance_ratio"),
        percent(F.col("held"), F.col("rows"), 4).alias("top10_share"),
    )


def class_coverage(counts: DataFrame, sizes=fixed.CLASS_SIZES) -> DataFrame:
    """Classes and rows kept when classes below each size are dropped."""
    wide = counts.groupBy("scheme").agg(
        F.sum("n").alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("min_size"),
                    F.sum(F.when(F.col("n") >= s, 1).otherwise(0)).alias("classes"),
                    F.sum(F.when(F.col("n") >= s, F.col("n")).otherwise(0)).alias("kept_rows"),
                )
                for s in sizes
            ]
        ).alias("kept"),
    )
    return wide.select("scheme", "rows", F.inline("kept")).select(
        "scheme", "min_size", "classes", "kept_rows",
        percent(F.col("kept_rows"), F.col("rows"), 4).alias("kept_pct"),
    )


def priority_distribution(df: DataFrame, column: str = "priority") -> DataFrame:
    """Class counts and shares, with the smallest class marked."""
    counts = value_counts(df, column, keep_null=False)
    # The window runs over the classes, not over the rows.
    whole = Window.partitionBy()
    return counts.select(
        F.col(column).alias("label"),
        "n",
        percent(F.col("n"), F.sum("n").over(whole), 4).alias("pct"),
        (F.col("n") == F.min("n").over(whole)).alias("is_smallest"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of whole numbers.

    ``percentile`` buffers one entry per distinct value, which is small for
    lengths; for real values use ``ranks.quantiles``.
    """
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(
        F.count(column).alias("count"),
        F.round(F.mean(column), 6).alias("mean"),
        F.round(F.stddev_samp(column), 6).alias("std"),
        F.min(column).cast("double").alias("min"),
        quartiles.alias("q"),
        F.max(column).cast("double").alias("max"),
    )
    return one.select(
        "count", "mean", "std", "min",
        F.round(F.col("q")[0], 6).alias("p25"),
        F.round(F.col("q")[1], 6).alias("p50"),
        F.round(F.col("q")[2], 6).alias("p75"),
        "max",
    )


def length_percentiles(df: DataFrame, column: str, probs=fixed.LENGTH_QUANTILES) -> DataFrame:
    found = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in probs])).alias("v"))
    rows = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("q"), F.col("v").alias("v"))
    return found.select(F.inline(rows)).toDF("q", "words").select(
        "q", F.round("words", 6).alias("words"), F.col("words").cast("long").alias("words_int")
    )


def cap_effect(df: DataFrame, column: str, caps=fixed.WORD_CAPS) -> DataFrame:
    """Rows and words lost at each length cap, in one pass."""
    n = F.col(column)
    wide = df.agg(
        F.count(n).alias("rows"),
        F.sum(n).alias("words"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("cap"),
                    F.sum(F.when(n > c, 1).otherwise(0)).alias("rows_over"),
                    F.sum(F.when(n > c, n - c).otherwise(0)).alias("words_cut"),
                )
                for c in caps
            ]
        ).alias("caps"),
    )
    return wide.select("rows", "words", F.inline("caps")).select(
        "cap", "rows_over",
        percent(F.col("rows_over"), F.col("rows"), 4).alias("rows_over_pct"),
        percent(F.col("words_cut"), F.col("words"), 4).alias("words_cut_pct"),
    )


def longest(df: DataFrame, column: str, *payload: str) -> DataFrame:
    """The row with the most words; ties go to the smallest id."""
    best = F.min_by(F.struct(column, *payload), F.struct(-F.col(column), payload[0]))
    return df.agg(best.alias("b")).select("b.*")


def copies(df: DataFrame, text_column: str, label: str | None = None) -> DataFrame:
    """Rows per normalised text, and distinct labels when asked."""
    keyed = df.withColumn("_key", text.text_hash(F.col(text_column)))
    if label is None:
        return keyed.groupBy("_key").agg(F.count("*").alias("rows"))
    # Counting (text, label) first keeps a text with very many copies small.
    pairs = keyed.groupBy("_key", label).agg(F.count("*").alias("n"))
    return pairs.groupBy("_key").agg(
        F.sum("n").alias("rows"), F.count(label).alias("labels")
    )


def duplicate_report(df: DataFrame, text_column: str) -> DataFrame:
    return copies(df, text_column).agg(
        F.sum("rows").alias("rows_with_text"),
        F.count("*").alias("distinct_texts"),
        F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("duplicate_rows"),
    )


def label_conflicts(df: DataFrame, text_column: str, label: str) -> DataFrame:
    """Repeated texts, and those that carry more than one label."""
    repeated = copies(df, text_column, label).where("rows > 1")
    return repeated.agg(
        F.count("*").alias("duplicate_texts"),
        F.sum((F.col("labels") > 1).cast("long")).alias("conflicting_texts"),
    )


def label_leakage(df: DataFrame) -> DataFrame:
    """Per scheme, rows whose text contains their own label."""
    rows = df.where("trainable_category")
    leaks = F.contains(F.lower("description"), F.lower("category"))
    found = rows.groupBy(F.col("category_scheme").alias("scheme")).agg(
        F.count("*").alias("rows"), F.sum(leaks.cast("long")).alias("leaked")
    )
    return found.withColumn("leaked_pct", percent(F.col("leaked"), F.col("rows"), 4))


def corpus_report(df: DataFrame, top: int = 10) -> DataFrame:
    """Retrievable rows by source, category (``top``) and priority."""
    rows = df.where("retrievable")

    def counted(facet: str, column: str) -> DataFrame:
        return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(
            F.lit(facet).alias("facet"), "value", "n"
        )

    by_category = (
        counted("category", "category")
        .where(F.col("value").isNotNull())
        .orderBy(F.desc("n"), "value")
        .limit(top)
    )
    return (
        counted("source", "source")
        .unionByName(by_category)
        .unionByName(counted("priority", "priority"))
    )


def drop_leaky_columns(df: DataFrame, columns=fixed.LEAK_COLUMNS) -> DataFrame:
    """Project away what is known only after a ticket is closed."""
    kept = df.drop(*columns)
    left = set(kept.columns) & set(columns)
    if left:
        raise ValueError(f"leaky columns left: {sorted(left)}")
    return kept
