"""One ticket table from several sources, with usability flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators.rows import settle
from triagelake.sources.tables import require_columns

TURNS_PER_PIECE = 1000


def adapt(
    df: DataFrame,
    prefix: str,
    ticket: Column,
    scheme: str,
    source: str,
    **fields: Column,
) -> DataFrame:
    """Project one source onto the unified columns; what it lacks is NULL."""
    known = {
        "ticket_id": F.concat(F.lit(prefix), ticket.cast("string")),
        "category_scheme": F.lit(scheme),
        "source": F.lit(source),
        **fields,
    }
    absent = F.lit(None).cast("string")
    return df.select(
        *[known.get(c, absent).cast("string").alias(c) for c in fixed.UNIFIED_COLUMNS]
    )


def adapt_helpdesk(issues: DataFrame) -> DataFrame:
    """Helpdesk issues; text comes from the conversations when joined."""
    require_columns(issues, "id", "issue_type", "priority_normalized", "issue_status")
    text_fields = {
        c: F.col(c) for c in ("description", "resolution") if c in issues.columns
    }
    return adapt(
        issues, "MND-", F.col("id"), "mendeley_issue_type", "mendeley",
        category=F.col("issue_type"),
        priority=F.col("priority_normalized"),
        status=F.col("issue_status"),
        **text_fields,
    )


def adapt_incidents(incidents: DataFrame) -> DataFrame:
    """Event-log snapshot: structured labels, no text."""
    require_columns(incidents, "number", "category", "priority_normalized", "incident_state")
    return adapt(
        incidents, "SNW-", F.col("number"), "servicenow_anonymized", "servicenow",
        category=F.col("category"),
        priority=F.col("priority_normalized"),
        status=F.col("incident_state"),
    )


def adapt_tracker(issues: DataFrame) -> DataFrame:
    """Issue tracker: text and project key, no priority or resolution."""
    require_columns(issues, "id", "corpus_clean", "project_key")
    clean = settle(issues, corpus_clean=text.collapse_ws(F.col("corpus_clean")))
    return adapt(
        clean, "JOS-", F.col("id"), "jira_project", "josse",
        description=F.col("corpus_clean"),
        category=F.col("project_key"),
    )


def conversation_text(
    utterances: DataFrame,
    roles: dict[str, str],
) -> DataFrame:
    """One row per issue with the joined turns of each role.

    ``roles`` maps a role to its output column.  Turns are gathered in
    pieces of bounded length, then the pieces are joined, so a long thread
    is sorted by many tasks.
    """
    body = text.squeeze(F.col("actionbody"))
    turns = utterances.where(
        F.col("author_role").isin(*roles) & F.col("issueid").isNotNull()
    ).select(
        "issueid",
        "author_role",
        F.coalesce(F.floor(F.col("comment_seq") / TURNS_PER_PIECE), F.lit(2**62)).alias("piece"),
        F.struct(
            F.col("comment_seq").isNull(), "comment_seq",
            F.col("utr_seq").isNull(), "utr_seq", body.alias("body"),
        ).alias("turn"),
    )
    turns = turns.where(F.col("turn.body") != "")
    pieces = turns.groupBy("issueid", "author_role", "piece").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["body"]), "\n"
        ).alias("body")
    )

    def joined(role: str) -> Column:
        mine = F.when(F.col("author_role") == role, F.struct("piece", "body"))
        bodies = F.transform(F.sort_array(F.collect_list(mine)), lambda p: p["body"])
        return F.nullif(F.array_join(bodies, "\n"), F.lit(""))

    return pieces.groupBy("issueid").agg(*[joined(r).alias(c) for r, c in roles.items()])


def enrich(
    issues: DataFrame,
    utterances: DataFrame,
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """Fill missing description and resolution from the conversations.

    ``enriched`` marks issues whose conversation gave a description.
    """
    roles = roles or {"reporter": "description", "assignee": "resolution"}
    spoken = conversation_text(utterances, roles)
    columns = list(roles.values())
    spoken = spoken.withColumnsRenamed({c: f"_{c}" for c in columns})
    joined = issues.join(spoken, issues["id"] == spoken["issueid"], "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in issues.columns else F.col(f"_{c}")
        for c in columns
    }
    joined = joined.withColumns(
        filled | {"enriched": F.col(f"_{columns[0]}").isNotNull()}
    )
    return joined.drop("issueid", *[f"_{c}" for c in columns])


def union_sources(*tables: DataFrame) -> DataFrame:
    first, *rest = [t.select(*fixed.UNIFIED_COLUMNS) for t in tables]
    for other in rest:
        first = first.unionByName(other)
    return first


def add_usability_flags(
    df: DataFrame,
    min_description: int = fixed.MIN_DESCRIPTION_WORDS,
    min_resolution: int = fixed.MIN_RESOLUTION_WORDS,
) -> DataFrame:
    """Word counts and the five flags; flags are never NULL."""
    counted = settle(
        df,
        description_word_count=text.word_count(F.col("description")),
        resolution_word_count=text.word_count(F.col("resolution")),
    )
    described = F.col("description_word_count") >= min_description
    resolved = F.col("resolution_word_count") >= min_resolution
    return counted.withColumns(
        {
            "has_description": described,
            "has_usable_resolution": resolved,
            "trainable_category": described & F.col("category").isNotNull(),
            "trainable_priority": described & F.col("priority").isNotNull(),
            "retrievable": described & resolved,
        }
    )


def repeated_ids(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_unique_ids(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Raise when ids repeat, naming how many rows are surplus."""
    surplus = repeated_ids(df, key).agg(F.sum(F.col("rows") - 1)).first()[0]
    if surplus:
        raise ValueError(f"{surplus} duplicate {key} values: the sources collide")
    return df
