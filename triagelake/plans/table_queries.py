"""Windows, unions, joins and reports, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators import cleaning, events, filters, profile, quality, split, unify
from triagelake.plans import duck, inputs
from triagelake.plans.registry import query

U = f"WITH {duck.UNIFIED}"


# --- event windows -----------------------------------------------------------

@query(
    "win_event_seq",
    """
SELECT event_id, user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS event_sequence,
       count(*) OVER (PARTITION BY user_id) AS incident_event_count
FROM events WHERE user_id IS NOT NULL
""",
)
def win_event_seq(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return events.add_sequence(rows, "user_id", "ts", "event_id").drop("ts")


@query(
    "win_event_count",
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS incident_event_count "
    "FROM events",
)
def win_event_count(t):
    return events.event_count(t.events.select("event_id", "user_id"), "user_id")


SNAPSHOT_SQL = """
SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts_us FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rn
  FROM events WHERE user_id IS NOT NULL) WHERE rn = 1
"""


@query("win_snapshot", SNAPSHOT_SQL)
def win_snapshot(t):
    last = events.snapshot(t.events, "user_id", "ts", "event_id")
    return last.withColumn("ts_us", events.micros("ts")).drop("ts")


@query(
    "win_keep_first",
    f"""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY {duck.text_key('text')}
""",
)
def win_keep_first(t):
    return filters.keep_first_text(t.documents.select("doc_id", "text"), "text", "doc_id").select(
        "doc_id"
    )


def _rank_sql(salt: str, by: str) -> str:
    return (
        f"row_number() OVER (PARTITION BY {by} ORDER BY md5({salt} || '-' || doc_id), doc_id)"
    )


SPLIT_SQL = f"""
WITH r AS (SELECT doc_id, lang, {_rank_sql("'42'", 'lang')} AS rn,
                  count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, rn <= CASE WHEN n >= 2 THEN greatest(round(0.2::DOUBLE * n), 1)
                           ELSE round(0.2::DOUBLE * n) END AS is_test FROM r
"""


@query("win_stratified_split", SPLIT_SQL)
def win_stratified_split(t):
    return split.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query("flt_holdout", f"SELECT doc_id, lang FROM ({SPLIT_SQL}) WHERE NOT is_test")
def flt_holdout(t):
    docs = t.documents.select("doc_id", "lang")
    test = split.stratified_split(docs, "lang", "doc_id").where("is_test")
    return split.holdout(docs, test, "doc_id")


@query(
    "win_folds",
    f"""
WITH x AS (SELECT doc_id, quality, repeat FROM labels, (SELECT unnest(range(5)) AS repeat))
SELECT doc_id, quality, CAST(repeat AS INT) AS repeat,
       CAST(({_rank_sql("'42-' || repeat", 'repeat, quality')} - 1) % 5 AS INT) AS fold FROM x
""",
)
def win_folds(t):
    return split.folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")


# --- union and adapters ------------------------------------------------------

COLUMNS = ", ".join(fixed.UNIFIED_COLUMNS)


@query("set_union_sources", f"{U} SELECT {COLUMNS} FROM tickets")
def set_union_sources(t):
    return unify.union_sources(
        unify.adapt_helpdesk(inputs.helpdesk(t)),
        unify.adapt_incidents(inputs.incidents(t)),
        unify.adapt_tracker(inputs.tracker(t)),
    )


@query("adapt_helpdesk", f"{U} SELECT {COLUMNS} FROM tickets WHERE source = 'mendeley'")
def adapt_helpdesk(t):
    return unify.adapt_helpdesk(inputs.helpdesk(t))


@query("adapt_incidents", f"{U} SELECT {COLUMNS} FROM tickets WHERE source = 'servicenow'")
def adapt_incidents(t):
    return unify.adapt_incidents(inputs.incidents(t))


@query("adapt_tracker", f"{U} SELECT {COLUMNS} FROM tickets WHERE source = 'josse'")
def adapt_tracker(t):
    return unify.adapt_tracker(inputs.tracker(t))


# --- joins -------------------------------------------------------------------

@query(
    "join_inner_quality",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
)
def join_inner_quality(t):
    docs = t.documents.select("doc_id", "lang")
    return docs.join(t.labels.select("doc_id", "quality", "toxic"), "doc_id", "inner")


@query(
    "join_left_enrich",
    f"""
WITH heard AS ({duck.spoken('user')}), told AS ({duck.spoken('assistant')})
SELECT doc_id AS id, heard.body AS description, told.body AS resolution,
       heard.body IS NOT NULL AS enriched,
       (SELECT count(*) FROM documents JOIN heard ON conv_id = doc_id) AS enriched_rows
FROM documents LEFT JOIN heard ON heard.conv_id = doc_id LEFT JOIN told ON told.conv_id = doc_id
""",
)
def join_left_enrich(t):
    issues = t.documents.select(F.col("doc_id").alias("id"))
    filled = unify.enrich(issues, inputs.utterances(t))
    total = filled.agg(F.sum(F.col("enriched").cast("long"))).scalar()
    return filled.withColumn("enriched_rows", total)


# --- reports -----------------------------------------------------------------

@query(
    "agg_value_counts",
    f"SELECT {duck.PRIORITY_CASE} AS priority, count(*) AS n FROM orders GROUP BY 1",
)
def agg_value_counts(t):
    rows = t.orders.select(
        cleaning.map_priority(F.col("o_orderpriority"), inputs.ORDER_PRIORITY).alias("priority")
    )
    return profile.value_counts(rows, "priority")


@query(
    "agg_conv_text",
    f"""
WITH heard AS ({duck.spoken('user')}), told AS ({duck.spoken('assistant')})
SELECT coalesce(heard.conv_id, told.conv_id) AS issueid, heard.body AS description,
       told.body AS resolution
FROM heard FULL JOIN told ON heard.conv_id = told.conv_id
""",
)
def agg_conv_text(t):
    return unify.conversation_text(
        inputs.utterances(t), {"reporter": "description", "assignee": "resolution"}
    )


PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
SPARK_TYPES = dict(zip(PROFILED, ("bigint", "string", "int", "double", "string")))
ZERO = {"c_custkey", "c_nationkey", "c_acctbal"}


def _profile_sql(c: str) -> str:
    placeholder = (
        f"CAST(sum(CASE WHEN lower(trim({c})) IN {duck.in_list(fixed.PROFILE_MISSING_TOKENS)} "
        "THEN 1 ELSE 0 END) AS BIGINT)"
        if SPARK_TYPES[c] == "string"
        else "0::BIGINT"
    )
    zero = f"count(*) FILTER ({c} = 0)" if c in ZERO else "0::BIGINT"
    return f"""
SELECT '{c}' AS "column", '{SPARK_TYPES[c]}' AS dtype, count(*) AS rows,
       count(*) - count({c}) AS missing_count, {placeholder} AS semantic_missing_count,
       count(DISTINCT {c}) AS unique_values, {zero} AS zero_count,
       (SELECT string_agg(v, ' | ' ORDER BY v) FROM (
          SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer WHERE {c} IS NOT NULL
          ORDER BY v LIMIT 5)) AS sample_values FROM customer"""


PROFILE_SQL = f"""
WITH p AS ({' UNION ALL '.join(_profile_sql(c) for c in PROFILED)})
SELECT *, {duck.pct('missing_count', 'rows')} AS missing_percent,
       {duck.pct('semantic_missing_count', 'rows')} AS semantic_missing_percent,
       missing_count + semantic_missing_count AS effective_missing_count,
       {duck.pct('missing_count + semantic_missing_count', 'rows')} AS effective_missing_percent
FROM p
"""


@query("agg_column_profile", PROFILE_SQL)
def agg_column_profile(t):
    return profile.column_profile(t.customer)


ORDER_MISSING = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
  THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders
"""


def orders_with_gaps(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = cleaning.null_placeholders(rows, ("4-not specified", "p"))
    return rows


@query(
    "agg_missing",
    f"""
WITH o AS ({ORDER_MISSING}), m AS (
  SELECT 'o_orderpriority' AS "column", count(*) - count(o_orderpriority) AS missing, count(*) AS n FROM o
  UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(*) FROM o
  UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(*) FROM o)
SELECT "column", missing, {duck.pct('missing', 'n')} AS missing_pct FROM m WHERE missing > 0
""",
)
def agg_missing(t):
    return profile.missing_values(orders_with_gaps(t))


@query(
    "top_missing",
    f"""
WITH o AS ({ORDER_MISSING}), m AS (
  SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS missing, count(DISTINCT o_orderkey) AS unique_values, count(*) AS n FROM o
  UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey), count(*) FROM o
  UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), count(*) FROM o
  UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) FROM o)
SELECT "column", {duck.pct('missing', 'n')} AS missing_percent, 0.0::DOUBLE AS semantic_missing_percent,
       {duck.pct('missing', 'n')} AS effective_missing_percent, unique_values
FROM m ORDER BY effective_missing_percent DESC, "column" LIMIT 15
""",
)
def top_missing(t):
    return profile.top_missing(profile.column_profile(orders_with_gaps(t)))


_FLAG_SUMS = ", ".join(f"CAST(sum({f}::INT) AS BIGINT) AS {f}" for f in profile.FLAGS)
_FLAG_PCTS = ", ".join(f"{duck.pct(f, 'rows')} AS {f}_pct" for f in profile.FLAGS)


@query(
    "agg_overview",
    f"""{U}, s AS (
  SELECT source, count(*) AS rows, {_FLAG_SUMS} FROM unified GROUP BY source
  UNION ALL SELECT 'all', count(*), {_FLAG_SUMS} FROM unified)
SELECT *, {_FLAG_PCTS} FROM s""",
)
def agg_overview(t):
    return profile.overview(inputs.unified(t))


COUNTS_SQL = f"""{U}, c AS (
  SELECT category_scheme AS scheme, category, count(*) AS n FROM unified
  WHERE trainable_category GROUP BY 1, 2)"""


def class_counts(t):
    return profile.category_counts(inputs.unified(t))


@query("agg_category_counts", f"{COUNTS_SQL} SELECT * FROM c")
def agg_category_counts(t):
    return class_counts(t)


@query(
    "agg_class_balance",
    f"""{COUNTS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY n DESC, category) AS top,
         row_number() OVER (PARTITION BY scheme ORDER BY n, category) AS low FROM c)
SELECT scheme, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, max(n) AS largest,
       max(category) FILTER (top = 1) AS largest_class, min(n) AS smallest,
       max(category) FILTER (low = 1) AS smallest_class,
       round(max(n) / min(n)::DOUBLE, 4) AS imbalance_ratio,
       {duck.pct('sum(n) FILTER (top <= 10)', 'sum(n)', 4)} AS top10_share
FROM r GROUP BY scheme""",
)
def agg_class_balance(t):
    return profile.class_balance(class_counts(t))


@query(
    "agg_class_coverage",
    f"""{COUNTS_SQL}, s AS (SELECT unnest([2, 5, 10, 20, 50]) AS min_size),
r AS (SELECT scheme, sum(n) AS rows FROM c GROUP BY scheme)
SELECT r.scheme, CAST(min_size AS INT) AS min_size,
       count(*) FILTER (n >= min_size) AS classes,
       CAST(coalesce(sum(n) FILTER (n >= min_size), 0) AS BIGINT) AS kept_rows,
       {duck.pct('coalesce(sum(n) FILTER (n >= min_size), 0)', 'any_value(rows)', 4)} AS kept_pct
FROM c JOIN r ON r.scheme = c.scheme, s GROUP BY r.scheme, min_size""",
)
def agg_class_coverage(t):
    return profile.class_coverage(class_counts(t))


@query(
    "top_classes",
    f"""{COUNTS_SQL}, r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY scheme ORDER BY n DESC, category) AS INT) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10""",
)
def top_classes(t):
    return profile.top_classes(class_counts(t))


@query(
    "agg_priority_dist",
    f"""
WITH c AS (SELECT {duck.PRIORITY_CASE} AS label, count(*) AS n FROM orders GROUP BY 1)
SELECT label, n, {duck.pct('n', 'sum(n) OVER ()', 4)} AS pct, n = min(n) OVER () AS is_smallest
FROM c WHERE label IS NOT NULL
""",
)
def agg_priority_dist(t):
    rows = t.orders.select(
        cleaning.map_priority(F.col("o_orderpriority"), inputs.ORDER_PRIORITY).alias("priority")
    )
    return profile.priority_distribution(rows)


LENGTHS = f"WITH l AS (SELECT doc_id, source, {duck.wc('text')} AS n FROM documents)"


def lengths(t):
    return t.documents.select("doc_id", "source", text.word_count(F.col("text")).alias("n"))


@query(
    "agg_describe",
    f"""{LENGTHS}
SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       min(n)::DOUBLE AS min, round(quantile_cont(n, 0.25), 6) AS p25,
       round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75,
       max(n)::DOUBLE AS max FROM l""",
)
def agg_describe(t):
    return profile.describe(lengths(t), "n")


_PERCENTILES = " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, round(quantile_cont(n, {q}), 6) AS words, "
    f"CAST(floor(quantile_cont(n, {q})) AS BIGINT) AS words_int FROM l"
    for q in fixed.LENGTH_QUANTILES
)


@query("agg_percentiles", f"{LENGTHS} {_PERCENTILES}")
def agg_percentiles(t):
    return profile.length_percentiles(lengths(t), "n")


@query(
    "agg_cap_effect",
    f"""{LENGTHS}, c AS (SELECT unnest([128, 256, 512, 1024]) AS cap)
SELECT CAST(cap AS INT) AS cap, count(*) FILTER (n > cap) AS rows_over,
       {duck.pct('count(*) FILTER (n > cap)', 'count(*)', 4)} AS rows_over_pct,
       {duck.pct('coalesce(sum(n - cap) FILTER (n > cap), 0)', 'sum(n)', 4)} AS words_cut_pct
FROM l, c GROUP BY cap""",
)
def agg_cap_effect(t):
    return profile.cap_effect(lengths(t), "n")


@query(
    "top_longest",
    f"{LENGTHS} SELECT n, doc_id, source FROM l ORDER BY n DESC, doc_id LIMIT 1",
)
def top_longest(t):
    return profile.longest(lengths(t), "n", "doc_id", "source")


@query(
    "agg_dup_report",
    f"""
WITH k AS (SELECT {duck.text_key('text')} AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows_with_text, count(*) AS distinct_texts,
       CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows FROM k
""",
)
def agg_dup_report(t):
    return profile.duplicate_report(t.documents, "text")


@query(
    "agg_label_conflicts",
    f"""
WITH k AS (SELECT {duck.text_key('text')} AS k, count(*) AS n, count(DISTINCT source) AS labels
           FROM documents GROUP BY 1)
SELECT count(*) AS duplicate_texts, count(*) FILTER (labels > 1) AS conflicting_texts
FROM k WHERE n > 1
""",
)
def agg_label_conflicts(t):
    return profile.label_conflicts(t.documents, "text", "source")


@query(
    "agg_corpus_report",
    f"""{U}, r AS (SELECT * FROM unified WHERE retrievable)
SELECT 'source' AS facet, source AS value, count(*) AS n FROM r GROUP BY source
UNION ALL (SELECT 'category', category, count(*) FROM r WHERE category IS NOT NULL
           GROUP BY category ORDER BY count(*) DESC, category LIMIT 10)
UNION ALL SELECT 'priority', priority, count(*) FROM r GROUP BY priority""",
)
def agg_corpus_report(t):
    return profile.corpus_report(inputs.unified(t))


@query(
    "agg_label_leakage",
    f"""{U}, docs AS (
  SELECT category_scheme AS scheme, category, description FROM unified WHERE trainable_category
  UNION ALL SELECT 'language', lang, text FROM documents),
l AS (SELECT scheme, count(*) AS rows,
             count(*) FILTER (contains(lower(description), lower(category))) AS leaked
      FROM docs GROUP BY scheme)
SELECT *, {duck.pct('leaked', 'rows', 4)} AS leaked_pct FROM l""",
)
def agg_label_leakage(t):
    columns = ("category_scheme", "category", "description", "trainable_category")
    languages = t.documents.select(
        F.lit("language"), "lang", "text", F.lit(True)
    ).toDF(*columns)
    return profile.label_leakage(inputs.unified(t).select(*columns).unionByName(languages))


@query(
    "flt_no_leak_columns",
    f"""{U} SELECT * EXCLUDE ({', '.join(fixed.LEAK_COLUMNS)}) FROM unified""",
)
def flt_no_leak_columns(t):
    return profile.drop_leaky_columns(inputs.unified(t))


@query(
    "agg_unique_ids",
    "SELECT doc_id, count(*) AS rows FROM (SELECT doc_id FROM documents UNION ALL "
    "SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1",
)
def agg_unique_ids(t):
    """Ids that repeat; documents alone pass the assertion."""
    docs = unify.assert_unique_ids(t.documents.select("doc_id"), "doc_id")
    return unify.repeated_ids(docs.unionByName(t.labels.select("doc_id")), "doc_id")


# --- boilerplate and content -------------------------------------------------

BOILER = duck.boiler("documents", "doc_id", "text")
CONTENT = duck.content("documents", "doc_id", "text")


def content(t):
    docs = t.documents.select("doc_id", "text")
    return quality.extract_content(docs, "text", quality.boilerplate(docs, "text"))


@query("agg_boilerplate", f"WITH {BOILER} SELECT key, docs, round(share, 6) AS share FROM boiler")
def agg_boilerplate(t):
    return quality.boilerplate(t.documents, "text").withColumn("share", F.round("share", 6))


@query(
    "top_boilerplate",
    f"WITH {BOILER} SELECT key, docs, round(share, 6) AS share FROM boiler "
    "ORDER BY share DESC, key LIMIT 20",
)
def top_boilerplate(t):
    found = quality.boilerplate(t.documents, "text")
    return quality.top_boilerplate(found.withColumn("share", F.round("share", 6)))


@query(
    "agg_extract_content",
    f"WITH {CONTENT} SELECT doc_id, resolution_content, content_words FROM content",
)
def agg_extract_content(t):
    return content(t).drop("text")


@query(
    "agg_content_floors",
    f"""WITH {CONTENT}, f AS (SELECT unnest([5, 10, 20, 30, 50]) AS floor)
SELECT CAST(floor AS INT) AS floor, count(*) FILTER (content_words >= floor) AS kept,
       {duck.pct('count(*) FILTER (content_words >= floor)', 'count(*)', 4)} AS kept_pct,
       round(100.0::DOUBLE * (1.0::DOUBLE - sum(content_words) / sum({duck.wc('raw')})::DOUBLE), 4) AS removed_pct
FROM content, f GROUP BY floor""",
)
def agg_content_floors(t):
    rows = content(t).withColumn("words", text.word_count(F.col("text")))
    return quality.content_floors(rows, "words", "content_words")


@query(
    "flt_content_floor",
    f"WITH {CONTENT} SELECT doc_id, content_words FROM content WHERE content_words >= 5",
)
def flt_content_floor(t):
    return (
        content(t)
        .where(F.col("content_words") >= fixed.MIN_CONTENT_WORDS)
        .select("doc_id", "content_words")
    )
