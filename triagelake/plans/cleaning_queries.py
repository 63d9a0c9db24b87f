"""Sources, sinks and cleaning, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators import cleaning, events as ev
from triagelake.operators.profile import drop_leaky_columns  # noqa: F401
from triagelake.plans import duck, inputs
from triagelake.plans.registry import query
from triagelake.session import new_dir
from triagelake.sources import sinks, tables

MISSING = (*fixed.MISSING_TOKENS, "4-not specified")
STATES = ("signup", "click", "purchase", "view")


# --- sources and sinks -------------------------------------------------------

@query("src_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv(t):
    """Multi-line text through a header CSV and back."""
    docs = t.documents
    path = sinks.write_csv(docs, new_dir(t.spark, "csv"))
    return tables.read_csv(t.spark, path, docs.schema)


@query("src_table", "SELECT * FROM orders")
def src_table(t):
    return tables.read_table(t.spark, t.path("orders"))


@query(
    "src_optional",
    "SELECT 'present' AS input, count(*) AS rows FROM conversations "
    "UNION ALL SELECT 'absent', 0",
)
def src_optional(t):
    """An enrichment table that exists, and one that does not."""
    schema = t.conversations.schema
    present = tables.read_optional(t.spark, t.path("conversations"), schema)
    absent = tables.read_optional(t.spark, t.path("no_such_table"), schema)
    return present.agg(F.lit("present").alias("input"), F.count("*").alias("rows")).unionByName(
        absent.agg(F.lit("absent").alias("input"), F.count("*").alias("rows"))
    )


@query("sink_table", f"WITH {duck.UNIFIED} SELECT * FROM unified")
def sink_table(t):
    """The unified table, written and read back."""
    return sinks.write_table(inputs.unified(t), new_dir(t.spark, "unified"))


@query(
    "sink_metrics",
    f"""
WITH d AS (SELECT *, {duck.markup('text')} AS clean FROM documents), m AS (
  SELECT count(*) AS rows_total, count(clean) AS with_text,
         CAST(sum({duck.wc('clean')}) AS BIGINT) AS words,
         CAST(sum(CASE WHEN {duck.wc('clean')} >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS described,
         count(DISTINCT source) AS sources FROM d)
SELECT 'rows_total' AS metric, rows_total AS value FROM m
UNION ALL SELECT 'with_text', with_text FROM m UNION ALL SELECT 'words', words FROM m
UNION ALL SELECT 'described', described FROM m UNION ALL SELECT 'sources', sources FROM m
""",
)
def sink_metrics(t):
    """All counters of a cleaning report from one aggregation."""
    clean = t.documents.select("source", text.strip_markup(F.col("text")).alias("clean"))
    n = text.word_count(F.col("clean"))
    return sinks.metric_rows(
        clean,
        {
            "rows_total": F.count("*"),
            "with_text": F.count("clean"),
            "words": F.sum(n),
            "described": F.sum((n >= 3).cast("long")),
            "sources": F.count_distinct("source"),
        },
    )


@query(
    "sink_feedback",
    """
SELECT event_type AS source, count(*) AS answers,
       CAST(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS useful_answers,
       round(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS useful_rate
FROM events GROUP BY event_type
""",
)
def sink_feedback(t):
    """Feedback appended in two batches, then its usefulness per source."""
    useful = F.when(F.col("value") >= 10, "yes").otherwise("no")
    log = t.events.select(
        F.col("ts"), F.col("props").alias("description"), F.col("event_type").alias("source"),
        F.lit(0).alias("num_similar"), F.lit(0).alias("num_steps"), useful.alias("useful"),
    )
    rows = sinks.feedback_rows(log, F.col("ts"))
    path = new_dir(t.spark, "feedback")
    sinks.append_feedback(rows.where("useful = 'yes'"), path)
    sinks.append_feedback(rows.where("useful = 'no'"), path)
    return sinks.usefulness(t.spark, path, rows.schema)


# --- cleaning ----------------------------------------------------------------

@query("clean_names", "SELECT * FROM orders")
def clean_names(t):
    raw = t.orders.toDF(*[f" {c.upper()} " for c in t.orders.columns])
    return cleaning.clean_names(raw)


@query(
    "clean_trim",
    f"SELECT doc_id, {duck.strip('text')} AS text, lang, source, n_chars FROM documents",
)
def clean_trim(t):
    padded = t.documents.withColumns(
        {c: F.concat(F.lit(" \t"), F.col(c), F.lit("\n ")) for c in ("text", "lang", "source")}
    )
    return cleaning.trim_text(padded)


@query(
    "clean_semantic_missing",
    f"""
SELECT o_orderkey, CASE WHEN o_orderstatus IN {duck.in_list(MISSING)} THEN NULL
         ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN lower(trim(o_orderpriority)) IN {duck.in_list(MISSING)} THEN NULL
         ELSE o_orderpriority END AS o_orderpriority,
       (SELECT count(*) FROM orders
        WHERE lower(trim(o_orderpriority)) IN {duck.in_list(MISSING)}) AS replaced
FROM orders
""",
)
def clean_semantic_missing(t):
    raw = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    replaced = raw.agg(cleaning.placeholder_count(raw, MISSING)).scalar()
    return cleaning.null_placeholders(raw, MISSING).withColumn("replaced", replaced)


@query(
    "clean_map_priority",
    f"SELECT o_orderkey, o_orderpriority, {duck.PRIORITY_CASE} AS priority FROM orders",
)
def clean_map_priority(t):
    return t.orders.select(
        "o_orderkey", "o_orderpriority",
        cleaning.map_priority(F.col("o_orderpriority"), inputs.ORDER_PRIORITY).alias("priority"),
    )


@query(
    "clean_parse_ts",
    """
SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(date_trunc('minute', ts)) END
         AS parsed_us, event_type = 'error' AS failed
FROM events
""",
)
def clean_parse_ts(t):
    """Day-first timestamps; error rows carry an unreadable one."""
    shown = F.date_format("ts", "d/M/yyyy H:mm")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("on "), shown)).otherwise(shown)
    df = t.events.select("event_id", raw.alias("raw"))
    parsed = cleaning.parse_event_ts(F.col("raw"))
    return df.select(
        "event_id",
        F.unix_micros(parsed.cast("timestamp")).alias("parsed_us"),
        cleaning.failed_parse(F.col("raw"), parsed).alias("failed"),
    )


@query(
    "clean_parse_ts_multi",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL
         WHEN 'view' THEN epoch_us(date_trunc('second', ts))
         WHEN 'click' THEN epoch_us(date_trunc('millisecond', ts))
         ELSE epoch_us(ts) END AS parsed_us,
       event_type = 'error' AS failed
FROM events
""",
)
def clean_parse_ts_multi(t):
    """UTC timestamps with none, three or six fractional digits."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.lit("pending"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS'+00:00'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'"))
    )
    df = t.events.select("event_id", raw.alias("raw"))
    parsed = cleaning.parse_issue_ts(F.col("raw"))
    return df.select(
        "event_id",
        F.unix_micros(parsed).alias("parsed_us"),
        cleaning.failed_parse(F.col("raw"), parsed).alias("failed"),
    )


@query(
    "clean_elapsed_hours",
    f"""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  {duck.hours('o_orderdate', 'l_shipdate')} AS h
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN h >= 0 THEN round(h, 6) END AS resolution_time_hours,
       h < 0 AS invalid_resolution_chronology FROM h
""",
)
def clean_elapsed_hours(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "l_shipdate"
    )
    timed = cleaning.add_elapsed(
        rows, "o_orderdate", "l_shipdate", "resolution_time_hours", "invalid_resolution_chronology"
    )
    return timed.withColumn(
        "resolution_time_hours", F.round("resolution_time_hours", 6)
    ).drop("o_orderdate", "l_shipdate")


@query(
    "clean_domain",
    f"""
SELECT event_id, CASE WHEN event_type IN {duck.in_list(STATES)} THEN event_type END AS event_type,
       event_type NOT IN {duck.in_list(STATES)} AS invalid_state,
       (SELECT count(*) FROM events WHERE event_type NOT IN {duck.in_list(STATES)}) AS invalid_rows
FROM events
""",
)
def clean_domain(t):
    checked = cleaning.check_domain(
        t.events.select("event_id", "event_type"), "event_type", STATES, "invalid_state"
    )
    total = checked.agg(F.sum(F.col("invalid_state").cast("long"))).scalar()
    return checked.withColumn("invalid_rows", total)


@query(
    "clean_negative_cells",
    """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
       CASE WHEN c_nationkey >= 0 THEN c_nationkey END AS c_nationkey,
       c_acctbal < 0 OR c_nationkey < 0 AS has_negative_value,
       CAST((c_acctbal < 0)::INT + (c_nationkey < 0)::INT AS BIGINT) AS negative_cells
FROM customer
""",
)
def clean_negative_cells(t):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    columns = cleaning.numeric_columns(df, "c_acct", "c_nation")
    return cleaning.null_negatives(df, columns, "has_negative_value", "negative_cells")


@query(
    "clean_numeric_audit",
    """
SELECT s_suppkey, CASE WHEN s_nationkey <> 3 AND s_acctbal >= 0 THEN s_acctbal END AS s_acctbal,
       s_nationkey <> 3 AND s_acctbal < 0 AS s_acctbal_was_negative FROM supplier
""",
)
def clean_numeric_audit(t):
    """Balances as text; one nation's suppliers have an unreadable one."""
    raw = F.when(F.col("s_nationkey") == 3, F.lit("not given")).otherwise(
        F.col("s_acctbal").cast("string")
    )
    return cleaning.audit_numeric(t.supplier.select("s_suppkey", raw.alias("s_acctbal")), ["s_acctbal"])


def marked_up():
    return F.concat(
        F.lit("{code:java}\r\n"), F.col("text"), F.lit("{CODE} [~"), F.col("source"),
        F.lit("]\r{NoFormat} end"),
    )


MARKED_UP = (
    "'{code:java}' || chr(13) || chr(10) || text || '{CODE} [~' || source || ']' "
    "|| chr(13) || '{NoFormat} end'"
)


@query("clean_markup", f"SELECT doc_id, {duck.markup(MARKED_UP)} AS clean FROM documents")
def clean_markup(t):
    return t.documents.select("doc_id", text.strip_markup(marked_up()).alias("clean"))


@query(
    "clean_text_stats",
    f"""
WITH d AS (SELECT doc_id, {duck.markup(MARKED_UP)} AS corpus_clean FROM documents)
SELECT doc_id, corpus_clean, CAST(coalesce(length(corpus_clean), 0) AS BIGINT) AS corpus_char_count,
       {duck.wc('corpus_clean')} AS corpus_word_count,
       corpus_clean IS NULL OR {duck.wc('corpus_clean')} = 0 AS empty_corpus FROM d
""",
)
def clean_text_stats(t):
    df = t.documents.select("doc_id", marked_up().alias("corpus"))
    return cleaning.add_text_stats(df, "corpus").drop("corpus")


@query("clean_collapse_ws", f"SELECT doc_id, {duck.collapse('text')} AS text FROM documents")
def clean_collapse_ws(t):
    return t.documents.select("doc_id", text.collapse_ws(F.col("text")).alias("text"))


@query(
    "clean_extract_key",
    r"""
SELECT o_orderkey,
       upper(nullif(regexp_extract(o_orderpriority, '^([A-Za-z0-9_]+)-', 1), '')) AS project_key
FROM orders
""",
)
def clean_extract_key(t):
    return t.orders.select("o_orderkey", text.project_key(F.col("o_orderpriority")).alias("project_key"))


@query(
    "clean_exact_dupes",
    """
WITH u AS (SELECT text, lang, source FROM documents
           UNION ALL SELECT text, lang, source FROM documents),
d AS (SELECT DISTINCT text, lang, source FROM u)
SELECT *, (SELECT count(*) FROM u) - (SELECT count(*) FROM d) AS removed FROM d
""",
)
def clean_exact_dupes(t):
    rows = t.documents.select("text", "lang", "source")
    doubled = rows.unionByName(rows)
    distinct = cleaning.drop_exact_duplicates(doubled)
    before = doubled.agg(F.count("*")).scalar()
    after = distinct.agg(F.count("*")).scalar()
    return distinct.withColumn("removed", before - after)


# --- whole passes ------------------------------------------------------------

@query(
    "clean_events_pass",
    f"""
WITH e AS (SELECT event_id, user_id, event_type, date_trunc('minute', ts) AS updated,
                  date_trunc('minute', CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR
                                       ELSE ts - INTERVAL 2 HOUR END) AS opened,
                  CASE WHEN event_type = 'view' THEN date_trunc('minute', ts + INTERVAL 3 HOUR) END AS resolved
           FROM events WHERE user_id IS NOT NULL),
h AS (SELECT *, {duck.hours('opened', 'updated')} AS age, {duck.hours('opened', 'resolved')} AS work FROM e)
SELECT event_id, user_id AS number, CASE event_type WHEN 'error' THEN 'P1' ELSE 'P3' END AS priority_normalized,
       CASE WHEN event_type <> 'click' THEN 'Active' END AS incident_state,
       event_type = 'click' AS invalid_incident_state,
       row_number() OVER (PARTITION BY user_id ORDER BY updated NULLS LAST, event_id) AS event_sequence,
       count(*) OVER (PARTITION BY user_id) AS incident_event_count,
       CASE WHEN age >= 0 THEN round(age, 6) END AS event_age_hours,
       coalesce(age < 0, FALSE) AS invalid_event_chronology,
       CASE WHEN work >= 0 THEN round(work, 6) END AS resolution_time_hours,
       coalesce(work < 0, FALSE) AS invalid_resolution_chronology
FROM h
""",
)
def clean_events_pass(t):
    """The whole event-log pass over events written out as a raw log, every
    third opened after it was updated."""
    late = F.col("event_id") % 3 == 0
    opened = F.when(late, F.expr("ts + INTERVAL 1 HOUR")).otherwise(F.expr("ts - INTERVAL 2 HOUR"))
    kind = F.col("event_type")
    shown = lambda c: F.date_format(c, "d/M/yyyy H:mm")
    raw = t.events.select(
        "event_id", F.col("user_id").alias(" Number "), shown(opened).alias("Opened_at"),
        shown("ts").alias("sys_updated_at"),
        F.when(kind == "view", shown(F.expr("ts + INTERVAL 3 HOUR"))).otherwise("?").alias("resolved_at"),
        F.lit(" ? ").alias("closed_at"),
        F.when(kind == "error", "1 - Critical").otherwise("3 - Moderate ").alias("priority"),
        F.when(kind == "click", "-100").otherwise("Active").alias("incident_state"),
    )
    done = ev.clean_events(raw.unionByName(raw.where("event_id % 10 = 0")), "event_id")
    return done.select(
        "event_id", "number", "priority_normalized", "incident_state", "invalid_incident_state",
        "event_sequence", "incident_event_count",
        F.round("event_age_hours", 6).alias("event_age_hours"), "invalid_event_chronology",
        F.round("resolution_time_hours", 6).alias("resolution_time_hours"),
        "invalid_resolution_chronology",
    )


@query(
    "clean_tracker_pass",
    f"""
WITH d AS (SELECT doc_id, source, {duck.markup(MARKED_UP)} AS clean FROM documents)
SELECT source || '-' || doc_id AS id, upper(source) AS project_key,
       CASE WHEN doc_id % 7 - 1 >= 0 THEN CAST(doc_id % 7 - 1 AS DOUBLE) END AS expert_estimated_effort,
       doc_id % 7 - 1 < 0 AS expert_estimated_effort_was_negative,
       CAST(NULL AS DOUBLE) AS actual_effort, CAST(coalesce(length(clean), 0) AS BIGINT) AS corpus_char_count,
       {duck.wc('clean')} AS corpus_word_count, {duck.wc('clean')} = 0 AS empty_corpus
FROM d
""",
)
def clean_tracker_pass(t):
    """The whole issue-tracker pass over documents as raw issues, some twice."""
    raw = t.documents.select(
        F.concat_ws("-", "source", "doc_id").alias("ID"), marked_up().alias(" Corpus"),
        (F.col("doc_id") % 7 - 1).cast("string").alias("expert_estimated_effort"),
        F.lit("N/A").alias("actual_effort"), F.lit(1).alias("num_comment"),
        F.lit(2).alias("num_activities"),
    )
    done = cleaning.clean_tracker(raw.unionByName(raw))
    return done.select(
        "id", "project_key", "expert_estimated_effort", "expert_estimated_effort_was_negative",
        "actual_effort", "corpus_char_count", "corpus_word_count", "empty_corpus",
    )
