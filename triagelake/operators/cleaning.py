"""Cleaning of raw issue and event tables."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import fixed, text
from triagelake.operators.rows import settle


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame, *prefixes: str) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name.startswith(prefixes)
    ]


def clean_names(df: DataFrame) -> DataFrame:
    """Strip and lower-case all column names."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names collide once lower-cased")
    return df.toDF(*names)


def trim_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.trim_ws(F.col(c)) for c in text_columns(df)})


def is_placeholder(c: Column, tokens=fixed.MISSING_TOKENS) -> Column:
    return F.coalesce(F.lower(text.trim_ws(c)).isin(*tokens), F.lit(False))


def placeholder_count(df: DataFrame, tokens=fixed.MISSING_TOKENS) -> Column:
    """Aggregate: placeholder cells over all text columns."""
    cells = [is_placeholder(F.col(c), tokens).cast("long") for c in text_columns(df)]
    return F.coalesce(F.sum(reduce(add, cells, F.lit(0))), F.lit(0))


def null_placeholders(df: DataFrame, tokens=fixed.MISSING_TOKENS) -> DataFrame:
    return df.withColumns(
        {
            c: F.when(~is_placeholder(F.col(c), tokens), F.col(c))
            for c in text_columns(df)
        }
    )


def map_priority(c: Column, levels: dict[str, str] = fixed.ISSUE_PRIORITY) -> Column:
    """Look the value up in ``levels``; anything else becomes NULL."""
    pairs = [F.lit(x) for pair in levels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(text.trim_ws(c)))


def parse_ts(c: Column, formats) -> Column:
    """First format that fits; NULL where none does."""
    if isinstance(formats, str):
        formats = (formats,)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_event_ts(c: Column, fmt: str = fixed.EVENT_TS_FORMAT) -> Column:
    """Timestamps of the event log carry no zone."""
    return parse_ts(c, fmt).cast("timestamp_ntz")


def parse_issue_ts(c: Column, formats=fixed.ISSUE_TS_FORMATS) -> Column:
    """UTC timestamps with or without one to six fractional digits."""
    return parse_ts(c, formats)


def failed_parse(raw: Column, parsed: Column) -> Column:
    """True where a value was present but no format fitted."""
    return raw.isNotNull() & parsed.isNull()


def elapsed_hours(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(3.6e9)


def add_elapsed(df: DataFrame, start: str, end: str, hours: str, invalid: str) -> DataFrame:
    """Hours from start to end; negative spans are flagged and nulled."""
    span = elapsed_hours(F.col(start), F.col(end))
    bad = F.coalesce(span < 0, F.lit(False))
    return df.withColumns({hours: F.when(~bad, span), invalid: bad})


def check_domain(df: DataFrame, column: str, allowed, flag: str) -> DataFrame:
    """Values outside ``allowed`` are flagged and nulled."""
    bad = F.coalesce(~F.col(column).isin(*allowed), F.lit(False))
    return df.withColumns({flag: bad, column: F.when(~bad, F.col(column))})


def null_negatives(df: DataFrame, columns: list[str], flag: str, cells: str) -> DataFrame:
    """Null negative cells of ``columns``; flag the row, count its cells."""
    bad = {c: F.coalesce(F.col(c) < 0, F.lit(False)) for c in columns}
    found = {
        flag: reduce(or_, bad.values(), F.lit(False)),
        cells: reduce(add, [b.cast("long") for b in bad.values()], F.lit(0)).cast("long"),
    }
    return df.withColumns(found | {c: F.when(~b, F.col(c)) for c, b in bad.items()})


def audit_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce to double; flag and null negative values column by column."""
    out = {}
    for c in columns:
        number = F.col(c).try_cast("double")
        bad = F.coalesce((number < 0) & ~F.isnan(number), F.lit(False))
        out[f"{c}_was_negative"] = bad
        out[c] = F.when(~bad & ~F.isnan(number), number)
    return df.withColumns(out)


def add_text_stats(df: DataFrame, source: str, clean: str = "corpus_clean") -> DataFrame:
    """Cleaned text, its length in characters and words, and whether empty."""
    with_text = settle(df, **{clean: text.strip_markup(F.col(source))})
    n = text.word_count(F.col(clean))
    return with_text.withColumns(
        {
            "corpus_char_count": F.coalesce(F.length(clean), F.lit(0)).cast("long"),
            "corpus_word_count": n,
            "empty_corpus": F.col(clean).isNull() | (n == 0),
        }
    )


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of fully equal rows.  Copies meet map-side first, so a row
    repeated very often costs one row per task in the shuffle."""
    return df.dropDuplicates()


def clean_issues(df: DataFrame) -> DataFrame:
    """Whole helpdesk pass, in order: names, trim, duplicates, placeholders,
    timestamps, priority, resolution time, workflow durations."""
    df = null_placeholders(drop_exact_duplicates(trim_text(clean_names(df))))
    stamps = ("started", "ended", "issue_created", "issue_resolution_date", "last_change_date")
    df = df.withColumns(
        {c: parse_issue_ts(F.col(c)) for c in stamps if c in df.columns}
    )
    df = df.withColumn("priority_normalized", map_priority(F.col("issue_priority")))
    df = add_elapsed(
        df, "issue_created", "issue_resolution_date",
        "resolution_time_hours", "invalid_resolution_chronology",
    )
    return null_negatives(
        df, numeric_columns(df, "wf_", "wfe_"),
        "has_negative_workflow_value", "negative_workflow_cells",
    )


def clean_tracker(df: DataFrame) -> DataFrame:
    """Whole issue-tracker pass with effort and count audits."""
    df = null_placeholders(drop_exact_duplicates(trim_text(clean_names(df))))
    df = audit_numeric(
        df,
        ["expert_estimated_effort", "actual_effort", "num_comment", "num_activities"],
    )
    df = add_text_stats(df, "corpus")
    return df.withColumn("project_key", text.project_key(F.col("id")))
