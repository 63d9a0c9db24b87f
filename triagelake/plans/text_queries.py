"""Text projections and filters, bound to documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators import filters, quality, split
from triagelake.operators.features import with_terms
from triagelake.plans import duck, inputs
from triagelake.plans.registry import query

# The texts hold no English support verbs, so the verb list is drawn from
# function words of their languages.
VERBS = ("with", "for", "dans", "avec", "para", "con", "und", "nicht")
PROCESS = (*fixed.PROCESS_PATTERNS, "tion tion", "these")
LANGS = "de|en|es|fr"


@query("txt_cap_words", f"SELECT doc_id, {duck.cap('text')} AS text FROM documents")
def txt_cap_words(t):
    return t.documents.select("doc_id", text.cap_words(F.col("text")).alias("text"))


@query(
    "txt_half_split",
    f"""
WITH w AS (SELECT doc_id, {duck.words('text')} AS w FROM documents)
SELECT doc_id, array_to_string(w[1:len(w) // 2], ' ') AS query_half,
       array_to_string(w[len(w) // 2 + 1:], ' ') AS document_half
FROM w WHERE len(w) >= 20
""",
)
def txt_half_split(t):
    return split.half_split(t.documents.select("doc_id", "text"), "text").drop("text")


@query(
    "txt_strip_labels",
    f"SELECT doc_id, {duck.strip_labels('text', LANGS)} AS text FROM documents",
)
def txt_strip_labels(t):
    """Language codes taken out of the texts, with any ``-<number>``."""
    return filters.strip_labels(t.documents, "text", "lang").select("doc_id", "text")


MASKED = "'ph_user ' || text || ' PH_code, ph_item_2'"


@query(
    "txt_strip_placeholders",
    "SELECT doc_id, " + duck.squeeze("text || ' ,'") + " AS text FROM documents",
)
def txt_strip_placeholders(t):
    masked = F.concat(F.lit("ph_user "), "text", F.lit(" PH_code, ph_item_2"))
    return t.documents.select("doc_id", text.strip_placeholders(masked).alias("text"))


@query(
    "txt_sentences",
    f"""
SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {duck.sentences('text')} AS s FROM documents)
""",
)
def txt_sentences(t):
    return t.documents.select(
        "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")
    )


@query(
    "txt_sentence_key",
    f"""
WITH s AS (SELECT conv_id, turn, unnest({duck.sentences('text')}) AS sentence FROM conversations)
SELECT conv_id, turn, sentence, {duck.skey('sentence')} AS sentence_key,
       {duck.step_key('sentence')} AS step_key FROM s
""",
)
def txt_sentence_key(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("sentence")
    )
    return rows.select(
        "*",
        text.sentence_key(F.col("sentence")).alias("sentence_key"),
        text.step_key(F.col("sentence")).alias("step_key"),
    )


GREETED = "'Hello, ' || text || ' Best regards, ph_name ph_team'"


@query(
    "txt_trim_edges",
    f"""
SELECT conv_id, turn, {duck.trim_edges(GREETED)} AS regards,
       {duck.trim_edges("'Dears: ' || text || ' Thanks and regards.'")} AS thanks
FROM conversations
""",
)
def txt_trim_edges(t):
    regards = F.concat(F.lit("Hello, "), "text", F.lit(" Best regards, ph_name ph_team"))
    thanks = F.concat(F.lit("Dears: "), "text", F.lit(" Thanks and regards."))
    return t.conversations.select(
        "conv_id", "turn",
        text.trim_edges(regards).alias("regards"),
        text.trim_edges(thanks).alias("thanks"),
    )


@query(
    "txt_dedupe_sentences",
    f"""
WITH s AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence
           FROM (SELECT doc_id, {duck.sentences('text')} AS s FROM documents)),
k AS (SELECT *, {duck.skey('sentence')} AS k FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS rn FROM k WHERE k <> ''),
j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM f WHERE rn = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN j USING (doc_id)
""",
)
def txt_dedupe_sentences(t):
    docs = t.documents.select("doc_id", F.col("text").alias("raw"))
    return quality.dedupe_sentences(docs, "raw", "text").drop("raw")


@query(
    "txt_tokens",
    f"""
WITH k AS (SELECT doc_id, {duck.tokens('text')} AS x FROM documents),
g AS (SELECT doc_id, x, {duck.with_bigrams('x')} AS terms FROM k)
SELECT doc_id, CAST(len(x) AS INT) AS unigrams, CAST(len(terms) AS INT) AS terms,
       md5(array_to_string(terms, '|')) AS digest FROM g
""",
)
def txt_tokens(t):
    """Unigrams and bigrams per document, shown by their digest."""
    rows = with_terms(t.documents.select("doc_id", "text"), "text", ngrams=(1, 2))
    n = F.size(text.tokens(F.col("text")))
    return rows.select(
        "doc_id", n.alias("unigrams"), F.size("terms").alias("terms"),
        F.md5(F.array_join("terms", "|")).alias("digest"),
    )


@query(
    "txt_ticket_gate",
    f"""
WITH d AS (SELECT doc_id, {duck.strip('text')} AS s FROM documents),
w AS (SELECT *, {duck.wc('s')} AS n FROM d)
SELECT doc_id, CASE WHEN n >= 3 AND s <> '' THEN {duck.cap('s', 2000)} END AS clean_text,
       CASE WHEN s = '' THEN {duck.lit(fixed.ERR_BLANK)}
            WHEN n < 3 THEN 'Too short to analyse - ' || n ||
              ' word(s). Describe the problem in at least 3.' END AS error,
       s <> '' AND n > 2000 AS truncated FROM w
""",
)
def txt_ticket_gate(t):
    return t.documents.select("doc_id", text.gate(F.col("text")).alias("g")).select(
        "doc_id", "g.*"
    )


@query(
    "txt_json_recover",
    """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS BIGINT) END AS k,
       event_type = 'error' AS unreadable FROM events
""",
)
def txt_json_recover(t):
    """Answers as JSON, as JSON within prose, and without any JSON."""
    kind = F.col("event_type")
    answer = (
        F.when(kind == "error", F.lit("sorry, I cannot help with that"))
        .when(kind == "view", F.concat(F.lit("Here you go:\n```json\n"), "props", F.lit("\n```")))
        .otherwise(F.col("props"))
    )
    parsed = text.recover_json(answer, "k long")
    return t.events.select(
        "event_id", parsed["k"].alias("k"), parsed.isNull().alias("unreadable")
    )


# --- filters -----------------------------------------------------------------

@query(
    "flt_usability",
    f"""WITH {duck.UNIFIED}
SELECT ticket_id, description_word_count, resolution_word_count, has_description,
       has_usable_resolution, trainable_category, trainable_priority, retrievable FROM unified""",
)
def flt_usability(t):
    return inputs.unified(t).select(
        "ticket_id", "description_word_count", "resolution_word_count", "has_description",
        "has_usable_resolution", "trainable_category", "trainable_priority", "retrievable",
    )


@query(
    "flt_scheme",
    f"""WITH {duck.UNIFIED}
SELECT ticket_id, category, description FROM unified
WHERE trainable_category AND category_scheme = 'jira_project'""",
)
def flt_scheme(t):
    return filters.one_scheme(inputs.unified(t), "jira_project").select(
        "ticket_id", "category", "description"
    )


@query(
    "flt_min_class",
    """
WITH c AS (SELECT lang || '/' || source AS label, count(*) AS n FROM documents GROUP BY 1),
k AS (SELECT label FROM c WHERE n >= 10)
SELECT doc_id, lang || '/' || source AS label, (SELECT count(*) FROM k) AS classes_kept,
       (SELECT count(*) FROM documents) -
       (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE n >= 10) AS rows_dropped
FROM documents WHERE lang || '/' || source IN (SELECT label FROM k)
""",
)
def flt_min_class(t):
    docs = t.documents.select("doc_id", F.concat_ws("/", "lang", "source").alias("label"))
    kept = filters.min_class(docs, "label", fixed.MIN_CLASS_SIZE)
    report = filters.min_class_report(docs, "label", fixed.MIN_CLASS_SIZE)
    return kept.withColumns(
        {
            "classes_kept": report.select("classes_kept").scalar(),
            "rows_dropped": report.select("rows_dropped").scalar(),
        }
    )


@query(
    "flt_min_words",
    f"""
WITH s AS (SELECT doc_id, {duck.strip_labels('text', LANGS)} AS text FROM documents)
SELECT doc_id, {duck.wc('text')} AS words FROM s WHERE {duck.wc('text')} >= 3
""",
)
def flt_min_words(t):
    stripped = filters.strip_labels(t.documents, "text", "lang")
    kept = filters.min_words(stripped, "text", fixed.MIN_TICKET_WORDS)
    return kept.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(
    "flt_actionable",
    f"""
WITH s AS (SELECT conv_id, turn, unnest({duck.sentences('text')}) AS raw FROM conversations),
k AS (SELECT conv_id, turn, trim(raw, {duck.lit(fixed.EDGE_CHARS)}) AS sentence FROM s)
SELECT conv_id, turn, sentence, {duck.actionable('sentence', VERBS, PROCESS)} AS actionable FROM k
""",
)
def flt_actionable(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("raw")
    ).select("conv_id", "turn", text.strip_chars(F.col("raw")).alias("sentence"))
    return rows.withColumn(
        "actionable", text.is_actionable(F.col("sentence"), VERBS, PROCESS)
    )
