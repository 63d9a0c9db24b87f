"""Event log: order, counts, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import fixed
from triagelake.operators import cleaning
from triagelake.operators.ranks import range_slice, sliced_row_number


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def add_sequence(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Add ``event_sequence`` and ``incident_event_count`` per incident.

    Both come from one join and one window over (incident, time slice), so
    an incident with a large part of the log is spread over many tasks.
    """
    keyed = df.where(F.col(key).isNotNull())
    return sliced_row_number(
        keyed,
        [key],
        range_slice(keyed, micros(ts)),
        [F.col(ts).asc_nulls_last(), F.col(tie)],
        rank="event_sequence",
        total="incident_event_count",
    )


def event_count(df: DataFrame, key: str) -> DataFrame:
    """Add the number of events of the incident to each row."""
    sizes = df.groupBy(key).agg(F.count("*").alias("incident_event_count"))
    return df.join(sizes, key)


def last_event_order(ts: str, tie: str):
    """Sort key of the last event; a missing time counts as latest."""
    return F.struct(F.col(ts).isNull(), F.col(ts), F.col(tie))


def snapshot(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """One row per incident: its last event.  Partial aggregation keeps one
    row per incident and task before the shuffle."""
    keyed = df.where(F.col(key).isNotNull())
    last = F.max_by(F.struct(*df.columns), last_event_order(ts, tie))
    return keyed.groupBy(F.col(key).alias("_key")).agg(last.alias("last")).select("last.*")


def clean_events(df: DataFrame, tie: str) -> DataFrame:
    """Whole event-log pass: text, placeholders, timestamps, priority,
    state, order and elapsed times."""
    df = cleaning.drop_exact_duplicates(cleaning.trim_text(cleaning.clean_names(df)))
    df = cleaning.null_placeholders(df, fixed.EVENT_MISSING_TOKENS)
    stamps = ("opened_at", "sys_created_at", "sys_updated_at", "resolved_at", "closed_at")
    df = df.withColumns(
        {c: cleaning.parse_event_ts(F.col(c)) for c in stamps if c in df.columns}
    )
    df = df.withColumn(
        "priority_normalized",
        cleaning.map_priority(F.col("priority"), fixed.EVENT_PRIORITY),
    )
    df = cleaning.check_domain(
        df, "incident_state", fixed.INCIDENT_STATES, "invalid_incident_state"
    )
    df = add_sequence(df, "number", "sys_updated_at", tie)
    for end, hours, invalid in (
        ("sys_updated_at", "event_age_hours", "invalid_event_chronology"),
        ("resolved_at", "resolution_time_hours", "invalid_resolution_chronology"),
        ("closed_at", "closure_time_hours", "invalid_closure_chronology"),
    ):
        df = cleaning.add_elapsed(df, "opened_at", end, hours, invalid)
    return df
