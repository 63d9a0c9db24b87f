"""How the given tables stand in for tickets, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text
from triagelake.operators import cleaning, events, quality, retrieval, unify
from triagelake.session import checkpoint, discard
from triagelake.sources.tables import Tables

ORDER_PRIORITY = {"1-urgent": "P1", "2-high": "P2", "3-medium": "P3", "5-low": "P4"}


def utterances(t: Tables) -> DataFrame:
    """Conversation turns as issue utterances."""
    roles = F.create_map(
        F.lit("user"), F.lit("reporter"), F.lit("assistant"), F.lit("assignee")
    )
    return t.conversations.select(
        F.col("conv_id").alias("issueid"),
        F.col("turn").alias("comment_seq"),
        F.lit(0).alias("utr_seq"),
        F.try_element_at(roles, F.col("role")).alias("author_role"),
        F.col("text").alias("actionbody"),
    )


def helpdesk(t: Tables) -> DataFrame:
    """Orders as helpdesk issues, described by their conversations."""
    issues = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("issue_type"),
        F.col("o_orderstatus").alias("issue_status"),
        cleaning.map_priority(F.col("o_orderpriority"), ORDER_PRIORITY).alias(
            "priority_normalized"
        ),
    )
    return unify.enrich(issues, utterances(t))


def incidents(t: Tables) -> DataFrame:
    """Latest event per user as an incident."""
    last = events.snapshot(t.events.select("user_id", "ts", "event_id", "event_type"),
                           "user_id", "ts", "event_id")
    return last.select(
        F.col("user_id").alias("number"),
        F.col("event_type").alias("category"),
        F.lit(None).cast("string").alias("priority_normalized"),
        F.col("event_type").alias("incident_state"),
    )


def tracker(t: Tables) -> DataFrame:
    """Documents as tracker issues keyed ``<source>-<id>``."""
    key = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return t.documents.select(
        key.alias("id"),
        text.strip_markup(F.col("text")).alias("corpus_clean"),
        text.project_key(key).alias("project_key"),
    )


def unified(t: Tables) -> DataFrame:
    """The unified ticket table of 15 columns."""
    return unify.add_usability_flags(
        unify.union_sources(
            unify.adapt_helpdesk(helpdesk(t)),
            unify.adapt_incidents(incidents(t)),
            unify.adapt_tracker(tracker(t)),
        )
    )


def desk(t: Tables) -> DataFrame:
    """Documents as tickets; the conversation of the same id resolves them."""
    told = unify.conversation_text(
        utterances(t), {"reporter": "reported", "assignee": "resolution"}
    )
    levels = F.create_map(F.lit(1), F.lit("P3"), F.lit(0), F.lit("P1"))
    labels = t.labels.select(
        "doc_id", F.try_element_at(levels, F.col("quality")).alias("priority")
    )
    rows = (
        t.documents.join(told, F.col("doc_id") == F.col("issueid"), "left")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.concat(F.lit("DOC-"), "doc_id").alias("ticket_id"),
            F.col("text").alias("description"),
            F.col("lang").alias("category"),
            "priority",
            "resolution",
            "source",
        )
    )
    return unify.add_usability_flags(rows)


def desk_corpus(t: Tables) -> DataFrame:
    """Retrieval corpus of the tickets, keyed ``corpus_id``."""
    tickets = checkpoint(desk(t).where("retrievable"))
    found = quality.boilerplate(tickets, "resolution")
    content = quality.extract_content(tickets, "resolution", found)
    corpus = retrieval.build_corpus(tickets, content, "doc_id")
    written = checkpoint(corpus.withColumn("corpus_id", F.col("doc_id")))
    discard(tickets)
    return written


def asked(t: Tables) -> DataFrame:
    """Every document as an incoming ticket."""
    return t.documents.select(F.col("doc_id").alias("query_id"), "text")
