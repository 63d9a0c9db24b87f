"""SQL fragments for the checking queries.

RE2 has no look-behind and its ``\\b`` is ASCII, so sentence splits and word
boundaries are spelled out.
"""

from triagelake.functions import fixed

WORD = r"\p{L}\p{N}_"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def collapse(t: str) -> str:
    return f"nullif({squeeze(t)}, '')"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def wc(t: str) -> str:
    return f"CAST(coalesce(len({words(t)}), 0) AS BIGINT)"


def sentences(t: str) -> str:
    cut = rf"regexp_replace({t}, '([.!?])\s+', '\1' || chr(10), 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({cut}, '\\n+'), "
        f"lambda s: {strip('s')}), lambda s: s <> '')"
    )


def skey(t: str) -> str:
    return squeeze(rf"regexp_replace(lower({t}), '[^a-z0-9_\s]', ' ', 'g')")


def step_key(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^a-z0-9 ]', '', 'g'))"


def trim_edges(t: str) -> str:
    for p in fixed.EDGE_PATTERNS:
        t = f"regexp_replace({t}, {lit(p)}, '', 'gi')"
    return f"trim({t}, {lit(fixed.EDGE_CHARS)})"


def text_key(t: str) -> str:
    return squeeze(f"lower({t})")


def markup(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '\{{code(:[^}}]*)?\}}|\{{noformat\}}', ' ', 'gi')"
    return collapse(rf"regexp_replace({t}, '\[~[^\]]+\]', ' ', 'g')")


def whole_word(body: str) -> str:
    return f"(^|[^{WORD}])(?:{body})($|[^{WORD}])"


def strip_labels(t: str, body: str) -> str:
    """Two passes, because neighbouring matches share a separator."""
    pattern = rf"(^|[^{WORD}])(?:{body})(?:-\d+)?($|[^{WORD}])"
    for _ in range(2):
        t = rf"regexp_replace({t}, {lit(pattern)}, '\1 \2', 'gi')"
    return squeeze(t)


def tokens(t: str, stop_words=fixed.STOP_WORDS) -> str:
    found = rf"regexp_extract_all(lower({t}), '[{WORD}]{{2,}}')"
    if not stop_words:
        return found
    return f"list_filter({found}, lambda w: w NOT IN {in_list(stop_words)})"


def with_bigrams(x: str) -> str:
    """``x`` is a column of tokens."""
    return (
        f"list_concat({x}, list_transform(range(1, greatest(len({x}), 1)), "
        f"lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    )


def cap(t: str, n: int = fixed.MAX_WORDS) -> str:
    return f"CASE WHEN {wc(t)} <= {n} THEN {t} ELSE {first_words(t, n)} END"


def first_words(t: str, n: int = fixed.MAX_WORDS) -> str:
    return f"array_to_string({words(t)}[1:{n}], ' ')"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100.0::DOUBLE * ({part}) / ({whole}), {digits})"


def hours(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 3600000000.0::DOUBLE"


def actionable(s: str, verbs, process, min_words: int = fixed.MIN_STEP_WORDS) -> str:
    bad = "|".join(f"(?:{p})" for p in process)
    return (
        f"({wc(s)} >= {min_words} AND NOT regexp_matches({s}, {lit(bad)}, 'i') "
        f"AND regexp_matches({s}, {lit(whole_word('|'.join(verbs)))}, 'i'))"
    )


# --- the unified ticket table ------------------------------------------------

PRIORITY_CASE = (
    "CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'P1' WHEN '2-high' THEN 'P2' "
    "WHEN '3-medium' THEN 'P3' WHEN '5-low' THEN 'P4' END"
)


def spoken(role: str) -> str:
    body = squeeze("text")
    return (
        f"SELECT conv_id, string_agg({body}, chr(10) ORDER BY turn) AS body "
        f"FROM conversations WHERE role = '{role}' AND {body} <> '' GROUP BY conv_id"
    )


UNIFIED = f"""
heard AS ({spoken('user')}),
told AS ({spoken('assistant')}),
latest AS (
  SELECT user_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1),
tickets AS (
  SELECT 'MND-' || o_orderkey AS ticket_id, heard.body AS description,
         o_orderstatus AS category, 'mendeley_issue_type' AS category_scheme,
         {PRIORITY_CASE} AS priority, told.body AS resolution,
         o_orderstatus AS status, 'mendeley' AS source
  FROM orders LEFT JOIN heard ON heard.conv_id = o_orderkey
              LEFT JOIN told ON told.conv_id = o_orderkey
  UNION ALL
  SELECT 'SNW-' || user_id, NULL, event_type, 'servicenow_anonymized', NULL, NULL,
         event_type, 'servicenow' FROM latest
  UNION ALL
  SELECT 'JOS-' || source || '-' || doc_id, {markup('text')}, upper(source), 'jira_project',
         NULL, NULL, NULL, 'josse' FROM documents),
counted AS (
  SELECT *, {wc('description')} AS description_word_count,
         {wc('resolution')} AS resolution_word_count FROM tickets),
unified AS (
  SELECT *, description_word_count >= 3 AS has_description,
         resolution_word_count >= 5 AS has_usable_resolution,
         description_word_count >= 3 AND category IS NOT NULL AS trainable_category,
         description_word_count >= 3 AND priority IS NOT NULL AS trainable_priority,
         description_word_count >= 3 AND resolution_word_count >= 5 AS retrievable
  FROM counted)
"""


# --- boilerplate and content -------------------------------------------------

def boiler(src: str, key: str, t: str) -> str:
    """CTEs ``sent``, ``keys``, ``boiler`` over the relation ``src``."""
    return f"""
sent AS (SELECT {key}, unnest({sentences(t)}) AS s FROM {src}),
keys AS (SELECT DISTINCT {key}, {skey(trim_edges('s'))} AS key FROM sent),
boiler AS (SELECT key, count(*) AS docs, count(*) / (SELECT count(*) FROM {src})::DOUBLE AS share
           FROM keys WHERE key <> '' GROUP BY key
           HAVING count(*) / (SELECT count(*) FROM {src})::DOUBLE >= {fixed.SENTENCE_SHARE})"""


def content(src: str, key: str, t: str) -> str:
    """CTE ``content (key, raw, resolution_content, content_words)``."""
    return f"""{boiler(src, key, t)},
seq AS (SELECT {key}, unnest(range(len(s))) AS pos, unnest(s) AS s
        FROM (SELECT {key}, {sentences(t)} AS s FROM {src})),
firsts AS (SELECT {key}, pos, s FROM (
             SELECT *, row_number() OVER (PARTITION BY {key}, {skey('s')} ORDER BY pos) AS rn
             FROM seq WHERE {skey('s')} <> '') WHERE rn = 1),
single AS (SELECT {key}, string_agg(s, ' ' ORDER BY pos) AS body FROM firsts GROUP BY {key}),
again AS (SELECT {key}, unnest(range(len(s))) AS pos, unnest(s) AS s
          FROM (SELECT {key}, {sentences('body')} AS s FROM single)),
kept AS (SELECT {key}, pos, {trim_edges('s')} AS s FROM again
         WHERE {skey('s')} NOT IN (SELECT key FROM boiler)),
joined AS (SELECT {key}, string_agg(s, ' ' ORDER BY pos) AS body FROM kept
           WHERE {wc('s')} >= 3 GROUP BY {key}),
content AS (SELECT d.{key}, d.{t} AS raw, coalesce(body, '') AS resolution_content,
                   {wc('body')} AS content_words
            FROM {src} d LEFT JOIN joined j ON j.{key} = d.{key})"""


# --- TF-IDF and search -------------------------------------------------------

def counts(name: str, src: str, key: str, t: str, bigrams: bool) -> str:
    """CTE ``name (key, term, tf)`` over the relation ``src``."""
    terms = with_bigrams("x") if bigrams else "x"
    return f"""
{name}_x AS (SELECT {key}, {tokens(t)} AS x FROM {src}),
{name} AS (SELECT {key}, term, count(*) AS tf
           FROM (SELECT {key}, unnest({terms}) AS term FROM {name}_x) GROUP BY {key}, term)"""


def idf(name: str, tf: str, src: str, min_df: int = 1, max_features: int | None = None) -> str:
    """CTE ``name (term, df, cf, idf)``."""
    limit = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""
{name} AS (SELECT term, df, cf, ln((1 + (SELECT count(*) FROM {src})) / (1 + df)::DOUBLE) + 1 AS idf
           FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {tf}
                 GROUP BY term HAVING count(*) >= {min_df} {limit}))"""


def weights(name: str, tf: str, idf_name: str, key: str) -> str:
    """CTE ``name (key, term, w)`` with unit rows."""
    return f"""
{name}_raw AS (SELECT {key}, term, (ln(tf) + 1) * idf AS w FROM {tf} JOIN {idf_name} USING (term)),
{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""


def hits(
    name: str, queries: str, corpus: str, qw: str, cw: str, k: int, where: str = "TRUE"
) -> str:
    """CTE ``name (query_id, rank, corpus_id, similarity)``; rows of
    ``queries`` and ``corpus`` without a shared term score zero."""
    return f"""
{name}_dot AS (SELECT query_id, corpus_id, sum(q.w * c.w) AS s
               FROM {qw} q JOIN {cw} c USING (term) GROUP BY query_id, corpus_id),
{name}_all AS (SELECT q.query_id, c.corpus_id, round(coalesce(s, 0), 9) AS similarity
               FROM (SELECT query_id FROM {queries}) q CROSS JOIN (SELECT corpus_id FROM {corpus}) c
               LEFT JOIN {name}_dot d ON d.query_id = q.query_id AND d.corpus_id = c.corpus_id
               WHERE {where}),
{name} AS (SELECT * FROM (
  SELECT query_id, corpus_id, similarity, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY similarity DESC, corpus_id) AS INT) AS rank FROM {name}_all)
  WHERE rank <= {k} AND similarity >= 0)"""


def sparse_hits(
    name: str, queries: str, corpus: str, k: int, bigrams: bool = True, where: str = "TRUE"
) -> str:
    """All CTEs of a TF-IDF search of ``queries (query_id, text)`` in
    ``corpus (corpus_id, text)``."""
    return ",".join(
        [
            counts(f"{name}_ct", corpus, "corpus_id", "text", bigrams),
            idf(f"{name}_idf", f"{name}_ct", corpus),
            weights(f"{name}_cw", f"{name}_ct", f"{name}_idf", "corpus_id"),
            counts(f"{name}_qt", queries, "query_id", "text", bigrams),
            weights(f"{name}_qw", f"{name}_qt", f"{name}_idf", "query_id"),
            hits(name, queries, corpus, f"{name}_qw", f"{name}_cw", k, where),
        ]
    )


def dense_hits(name: str, k: int, where: str = "TRUE") -> str:
    """Embeddings against themselves."""
    return f"""
{name} AS (SELECT * FROM (
  SELECT query_id, corpus_id, similarity, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY similarity DESC, corpus_id) AS INT) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
               round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings q CROSS JOIN embeddings c WHERE {where}))
  WHERE rank <= {k} AND similarity >= 0)"""


# --- documents with a conversation as tickets with a resolution --------------

DESK = f"""
heard AS ({spoken('user')}),
told AS ({spoken('assistant')}),
desk_raw AS (SELECT d.doc_id, 'DOC-' || d.doc_id AS ticket_id, d.text AS description,
       d.lang AS category, CASE l.quality WHEN 1 THEN 'P3' WHEN 0 THEN 'P1' END AS priority,
       told.body AS resolution, d.source
  FROM documents d LEFT JOIN told ON told.conv_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
desk AS (SELECT * FROM desk_raw
         WHERE {wc('description')} >= 3 AND {wc('resolution')} >= 5)"""

CORPUS = f"""{DESK}, {content('desk', 'ticket_id', 'resolution')},
usable AS (SELECT desk.* EXCLUDE (resolution), resolution_content AS resolution, content_words
           FROM desk JOIN content USING (ticket_id) WHERE content_words >= 5),
corpus AS (SELECT *, doc_id AS corpus_id, {first_words('description')} AS text FROM usable
           WHERE doc_id IN (SELECT min(doc_id) FROM usable GROUP BY {text_key('description')}))"""

ASKED = "asked AS (SELECT doc_id AS query_id, text FROM documents)"
DESK_HITS = (
    f"{CORPUS}, {ASKED}, "
    + sparse_hits("hits", "asked", "corpus", fixed.TOP_K, where="q.query_id <> c.corpus_id")
)
