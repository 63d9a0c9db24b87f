"""Evaluation, topics and training sets, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators import cleaning, evaluate, filters, split, topics
from triagelake.plans import duck, inputs
from triagelake.plans.registry import query
from triagelake.plans.text_queries import LANGS

# --- predictions by a fixed rule, so that every figure can be checked --------

RULES = {
    "letters": (("ß", "ä"), ("ñ", "ó"), ("è", "ê")),
    "words": ((" und ", " der "), (" los ", " para "), (" les ", " dans ")),
}
ORDER = ("de", "es", "fr")


def predicted(t, rule: str):
    """Documents with their language and a language guessed by ``rule``."""
    guess = F.lit("en")
    for lang, marks in reversed(list(zip(ORDER, RULES[rule]))):
        found = F.contains("text", F.lit(marks[0])) | F.contains("text", F.lit(marks[1]))
        guess = F.when(found, lang).otherwise(guess)
    return t.documents.select("doc_id", "lang", guess.alias("guess"))


def confusion_sql(rule: str, name: str) -> str:
    whens = " ".join(
        f"WHEN contains(text, '{m[0]}') OR contains(text, '{m[1]}') THEN '{lang}'"
        for lang, m in zip(ORDER, RULES[rule])
    )
    return (
        f"{name} AS (SELECT lang AS actual, CASE {whens} ELSE 'en' END AS predicted, "
        "count(*) AS n FROM documents GROUP BY 1, 2)"
    )


def per_class_sql(conf: str, name: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
{name}_s AS (SELECT {keys}actual AS label, n AS support, 0 AS guessed,
               CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM {conf}
             UNION ALL SELECT {keys}predicted, 0, n, 0 FROM {conf}),
{name}_g AS (SELECT {keys}label, CAST(sum(support) AS BIGINT) AS support, sum(guessed) AS guessed,
               CAST(sum(tp) AS BIGINT) AS tp FROM {name}_s GROUP BY {keys}label),
{name} AS (SELECT {keys}label, support, tp,
             CASE WHEN guessed > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall,
             CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed)::DOUBLE ELSE 0 END AS f1
           FROM {name}_g)"""


def summary_sql(classes: str, name: str, by: str) -> str:
    return f"""
{name} AS (SELECT {by}, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(f1) AS f1_macro,
             avg(precision) AS precision_macro, avg(recall) AS recall_macro
           FROM {classes} GROUP BY {by})"""


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "ev_confusion",
    f"""WITH {confusion_sql('letters', 'c')}, l AS (SELECT actual AS l FROM c UNION SELECT predicted FROM c)
SELECT a.l AS actual, b.l AS predicted, coalesce(n, 0) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.l AND c.predicted = b.l""",
)
def ev_confusion(t):
    return evaluate.confusion_grid(evaluate.confusion(predicted(t, "letters"), "lang", "guess"))


def classes(t, rule="letters"):
    return evaluate.per_class(evaluate.confusion(predicted(t, rule), "lang", "guess"))


CLASSES = f"WITH {confusion_sql('letters', 'c')}, {per_class_sql('c', 'p')}"


@query(
    "ev_per_class",
    f"""{CLASSES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, support FROM p""",
)
def ev_per_class(t):
    return rounded(classes(t).drop("tp"), "precision", "recall", "f1")


@query(
    "ev_summary",
    f"""{CLASSES} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
    round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
    round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro FROM p""",
)
def ev_summary(t):
    return rounded(
        evaluate.summary(classes(t)),
        "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro",
    )


@query(
    "ev_variant_delta",
    f"""{CLASSES}, {confusion_sql('words', 'd')}, {per_class_sql('d', 'q')}
SELECT p.label, p.support, round(p.f1, 6) AS f1_first, round(q.f1, 6) AS f1_second,
       round(q.f1 - p.f1, 6) AS delta,
       CASE WHEN p.f1 <> 0 THEN round(100 * (q.f1 - p.f1) / p.f1, 6) END AS delta_pct,
       CASE WHEN q.f1 < p.f1 THEN 'worse' WHEN q.f1 > p.f1 THEN 'better' ELSE 'same' END AS change
FROM p JOIN q ON q.label = p.label""",
)
def ev_variant_delta(t):
    rows = evaluate.variant_delta(classes(t), classes(t, "words"))
    return rounded(rows, "f1_first", "f1_second", "delta", "delta_pct")


@query(
    "top_worst_classes",
    f"""WITH c AS (SELECT source AS actual, CASE WHEN n_chars % 2 = 0 THEN source ELSE 'src0' END
    AS predicted, count(*) AS n FROM documents GROUP BY 1, 2), {per_class_sql('c', 'p')}
SELECT label, round(f1, 6) AS f1, support FROM p ORDER BY round(f1, 6), label LIMIT 15""",
)
def top_worst_classes(t):
    """Sources guessed right only for texts of even length."""
    guess = F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("src0")
    rows = t.documents.select("source", guess.alias("guess"))
    found = evaluate.per_class(evaluate.confusion(rows, "source", "guess"))
    return evaluate.worst_classes(rounded(found, "f1")).select("label", "f1", "support")


# --- folds, baseline, gain ---------------------------------------------------

FOLDS = """x AS (SELECT doc_id, quality, repeat FROM labels, (SELECT unnest(range(5)) AS repeat)),
folded AS (SELECT doc_id, quality, repeat, (row_number() OVER (PARTITION BY repeat, quality
             ORDER BY md5('42-' || repeat || '-' || doc_id), doc_id) - 1) % 5 AS fold FROM x)"""

MAJORITY = f"""{FOLDS},
tc AS (SELECT repeat, fold, quality AS actual, count(*) AS n FROM folded GROUP BY ALL),
tr AS (SELECT f.repeat, f.fold, t.actual, sum(t.n) - coalesce(any_value(o.n), 0) AS train
       FROM (SELECT DISTINCT repeat, fold FROM tc) f JOIN tc t ON t.repeat = f.repeat
       LEFT JOIN tc o ON o.repeat = f.repeat AND o.fold = f.fold AND o.actual = t.actual
       GROUP BY f.repeat, f.fold, t.actual),
pick AS (SELECT repeat, fold, actual AS predicted FROM (SELECT *, row_number() OVER (
           PARTITION BY repeat, fold ORDER BY train DESC, actual) AS rn FROM tr) WHERE rn = 1),
bc AS (SELECT tc.*, predicted FROM tc JOIN pick USING (repeat, fold)),
{per_class_sql('bc', 'bp', 'repeat, fold')}, {summary_sql('bp', 'bs', 'repeat, fold')}"""

MEANS = ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std"
    for m in evaluate.METRICS
)
MEAN_COLUMNS = [f"{m}_{f}" for m in evaluate.METRICS for f in ("mean", "std")]


def baseline_scores(t):
    folded = split.folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")
    return evaluate.mean_and_std(
        evaluate.fold_scores(evaluate.majority_confusion(folded, "quality"))
    )


@query("ev_baseline", f"WITH {MAJORITY} SELECT {MEANS} FROM bs")
def ev_baseline(t):
    return rounded(baseline_scores(t), *MEAN_COLUMNS)


@query(
    "ev_gain_check",
    f"""WITH {MAJORITY},
mc AS (SELECT repeat, fold, quality AS actual, CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS predicted,
              count(*) AS n FROM folded JOIN documents USING (doc_id) GROUP BY ALL),
{per_class_sql('mc', 'mp', 'repeat, fold')}, {summary_sql('mp', 'ms', 'repeat, fold')},
g AS (SELECT avg(f1_macro) AS f1_macro_mean, stddev_pop(f1_macro) AS f1_macro_std,
             (SELECT avg(f1_macro) FROM bs) AS baseline_f1_macro FROM ms)
SELECT round(f1_macro_mean, 6) AS f1_macro_mean, round(f1_macro_std, 6) AS f1_macro_std,
       round(baseline_f1_macro, 6) AS baseline_f1_macro,
       round(f1_macro_mean - baseline_f1_macro, 6) AS gain,
       f1_macro_mean - baseline_f1_macro >= 2 * f1_macro_std AS convincing FROM g""",
)
def ev_gain_check(t):
    """A length rule against the majority class."""
    folded = split.folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")
    guess = F.when(F.col("n_chars") >= 600, 1).otherwise(0).alias("guess")
    guessed = folded.join(t.documents.select("doc_id", guess), "doc_id")
    counts = evaluate.confusion(guessed, "quality", "guess", ("repeat", "fold"))
    model = evaluate.mean_and_std(evaluate.fold_scores(counts))
    rows = evaluate.gain_check(model, baseline_scores(t))
    return rounded(rows, "f1_macro_mean", "f1_macro_std", "baseline_f1_macro", "gain")


@query(
    "ev_small_class",
    """
WITH c AS (SELECT lang || '/' || source AS label, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) AS classes, min(n) AS smallest_class, min(n) < 5 AS unreliable_folds,
       min(n) < 5 AS unsplittable, min(n) < 15 AS uncalibrated FROM c
""",
)
def ev_small_class(t):
    rows = t.documents.select(F.concat_ws("/", "lang", "source").alias("label"))
    return evaluate.small_class_check(rows, "label")


SHUFFLED = """
base AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42-' || vec_id), vec_id) AS r FROM embeddings),
drawn AS (SELECT perm, label, row_number() OVER (
            PARTITION BY perm ORDER BY md5('42-' || perm || '-' || vec_id), vec_id) AS r
          FROM embeddings, (SELECT unnest(range(1, 101)) AS perm)),
lab AS (SELECT 0 AS perm, vec_id, label FROM embeddings
        UNION ALL SELECT perm, vec_id, label FROM drawn JOIN base USING (r))"""


@query(
    "ev_permutation_labels",
    f"WITH {SHUFFLED} SELECT CAST(perm AS INT) AS perm, vec_id, label FROM lab WHERE perm > 0",
)
def ev_permutation_labels(t):
    """The shuffled labels of all permutations."""
    return split.shuffled_labels(t.embeddings.select("vec_id", "label"), "label", "vec_id")


@query(
    "ev_permutation",
    f"""WITH {SHUFFLED},
fl AS (SELECT *, (row_number() OVER (PARTITION BY perm, label
         ORDER BY md5('42-' || vec_id), vec_id) - 1) % 5 AS fold FROM lab),
spread AS (SELECT fl.perm, fl.label, fl.fold, unnest(range(64)) AS dim,
                  unnest(embedding::DOUBLE[]) AS v FROM fl JOIN embeddings e USING (vec_id)),
part AS (SELECT perm, label, fold, dim, sum(v) AS s, count(*) AS m FROM spread GROUP BY ALL),
tot AS (SELECT perm, label, dim, sum(s) AS s, sum(m) AS m FROM part GROUP BY ALL),
cen AS (SELECT t.perm, f.fold, t.label,
               list((t.s - coalesce(p.s, 0)) / (t.m - coalesce(p.m, 0)) ORDER BY t.dim) AS c
        FROM tot t CROSS JOIN (SELECT unnest(range(5)) AS fold) f
        LEFT JOIN part p ON p.perm = t.perm AND p.label = t.label AND p.dim = t.dim AND p.fold = f.fold
        WHERE t.m > coalesce(p.m, 0) GROUP BY ALL),
sc AS (SELECT fl.perm, fl.vec_id, fl.label AS actual, cen.label AS cand,
              list_dot_product(c, c) - 2 * list_dot_product(e.embedding::DOUBLE[], c) AS d
       FROM fl JOIN embeddings e USING (vec_id) JOIN cen ON cen.perm = fl.perm AND cen.fold = fl.fold),
pr AS (SELECT perm, actual, arg_min(cand, d) AS predicted FROM sc GROUP BY perm, vec_id, actual),
c AS (SELECT perm, actual, predicted, count(*) AS n FROM pr GROUP BY ALL),
{per_class_sql('c', 'p', 'perm')},
f AS (SELECT perm, round(avg(f1), 9) AS f1 FROM p GROUP BY perm)
SELECT round((SELECT f1 FROM f WHERE perm = 0), 6) AS real, round(avg(f1), 6) AS shuffled_mean,
       round(max(f1), 6) AS shuffled_max,
       round((1 + count(*) FILTER (f1 >= (SELECT f1 FROM f WHERE perm = 0))) / (count(*) + 1)::DOUBLE, 6)
         AS p_value
FROM f WHERE perm > 0""",
)
def ev_permutation(t):
    """100 label shuffles of the embeddings, scored in one job."""
    scores = evaluate.permutation_scores(t.embeddings, "vec_id", "label", "embedding")
    return rounded(
        evaluate.permutation_p(scores), "real", "shuffled_mean", "shuffled_max", "p_value"
    )


# --- targets and training sets -----------------------------------------------

@query(
    "ml_binary_target",
    f"""WITH p AS (SELECT o_orderkey, {duck.PRIORITY_CASE} AS priority FROM orders)
SELECT o_orderkey, CASE WHEN priority IN ('P1', 'P2') THEN 'High' ELSE 'Low' END AS target
FROM p WHERE priority IS NOT NULL""",
)
def ml_binary_target(t):
    level = cleaning.map_priority(F.col("o_orderpriority"), inputs.ORDER_PRIORITY)
    rows = t.orders.select("o_orderkey", level.alias("priority"))
    binary = {k.lower(): v for k, v in fixed.BINARY_PRIORITY.items()}
    target = cleaning.map_priority(F.col("priority"), binary)
    return rows.select("o_orderkey", target.alias("target")).where(F.col("target").isNotNull())


def training_set(t):
    """``(stage name, rows)`` in the fixed order of preparation."""
    rows = t.documents.select(
        "doc_id", "text", "lang", F.concat_ws("/", "lang", "source").alias("label")
    )
    first = filters.keep_first_text(rows, "text", "doc_id")
    capped = first.withColumn("text", text.cap_words(F.col("text")))
    stripped = filters.strip_labels(capped, "text", "lang")
    worded = filters.min_words(stripped, "text", fixed.MIN_TICKET_WORDS)
    final = filters.min_class(worded, "label")
    return {"scheme": rows, "distinct": first, "worded": worded, "final": final}


@query(
    "ml_training_set",
    f"""
WITH r AS (SELECT doc_id, text, lang || '/' || source AS label FROM documents),
d AS (SELECT * FROM r WHERE doc_id IN (SELECT min(doc_id) FROM r GROUP BY {duck.text_key('text')})),
s AS (SELECT doc_id, label, {duck.strip_labels('(' + duck.cap('text') + ')', LANGS)} AS text FROM d),
w AS (SELECT * FROM s WHERE {duck.wc('text')} >= 3),
f AS (SELECT * FROM w WHERE label IN (SELECT label FROM w GROUP BY label HAVING count(*) >= 10))
SELECT 'scheme' AS stage, count(*) AS rows, count(DISTINCT label) AS classes FROM r
UNION ALL SELECT 'distinct', count(*), count(DISTINCT label) FROM d
UNION ALL SELECT 'worded', count(*), count(DISTINCT label) FROM w
UNION ALL SELECT 'final', count(*), count(DISTINCT label) FROM f
""",
)
def ml_training_set(t):
    """Rows and classes left after each preparation step."""
    out = None
    for stage, rows in training_set(t).items():
        counted = rows.agg(
            F.lit(stage).alias("stage"), F.count("*").alias("rows"),
            F.count_distinct("label").alias("classes"),
        )
        out = counted if out is None else out.unionByName(counted)
    return out


# --- topics ------------------------------------------------------------------

LONG = """
long AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
size AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
mean AS (SELECT label, dim, sum(v) AS s, avg(v) AS m FROM long GROUP BY label, dim),
cen AS (SELECT label AS cluster, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM mean),
vec AS (SELECT cluster, list(c ORDER BY dim) AS centroid FROM cen GROUP BY cluster)"""

SILHOUETTE = f"""{LONG},
norm AS (SELECT vec_id, label, dim, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM long),
sums AS (SELECT label, dim, sum(v) AS s FROM norm GROUP BY label, dim),
dots AS (SELECT x.vec_id, x.label, s.label AS other, sum(x.v * s.s) AS d
         FROM norm x JOIN sums s USING (dim) GROUP BY x.vec_id, x.label, s.label),
ab AS (SELECT vec_id, label,
              max(CASE WHEN label = other THEN 1 - (d - 1) / (n - 1) END) AS a,
              min(CASE WHEN label <> other THEN 1 - d / n END) AS b
       FROM (SELECT dots.*, size.n FROM dots JOIN size ON size.label = dots.other) GROUP BY vec_id, label)"""


@query(
    "tp_silhouette",
    f"WITH {SILHOUETTE} SELECT vec_id, label AS cluster, "
    "round((b - a) / greatest(a, b), 6) AS silhouette FROM ab",
)
def tp_silhouette(t):
    return rounded(topics.silhouette(t.embeddings, "label", "embedding", "vec_id"), "silhouette")


def centroid_table(t):
    return topics.centroids(t.embeddings, "label", "embedding")


@query(
    "tp_centroids",
    f"WITH {LONG} SELECT cluster, n, CAST(dim AS INT) AS dim, round(c, 6) AS value "
    "FROM cen JOIN size ON size.label = cen.cluster",
)
def tp_centroids(t):
    rows = centroid_table(t)
    return rounded(rows.select("cluster", "n", F.posexplode("centroid").alias("dim", "value")), "value")


OWN = f"""{LONG},
own AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], v.centroid) AS similarity
        FROM embeddings e JOIN vec v ON v.cluster = e.label),
fl AS (SELECT quantile_cont(similarity, 0.1) AS floor, quantile_cont(similarity, 0.5) AS median FROM own)"""


def own(t):
    return topics.own_similarity(t.embeddings, centroid_table(t), "label", "embedding")


@query("tp_floor", f"WITH {OWN} SELECT round(floor, 6) AS floor, round(median, 6) AS median FROM fl")
def tp_floor(t):
    return rounded(topics.assignment_floor(own(t)), "floor", "median")


@query(
    "tp_assign",
    f"""WITH {OWN}, s AS (SELECT e.vec_id, v.cluster,
         round(list_dot_product(e.embedding::DOUBLE[], v.centroid), 12) AS sim
       FROM embeddings e CROSS JOIN vec v),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) AS rn FROM s)
SELECT vec_id, cluster, 'topic ' || cluster AS label, round(sim, 6) AS confidence,
       sim < floor AS uncertain, NULL AS error FROM r, fl WHERE rn = 1""",
)
def tp_assign(t):
    model = centroid_table(t).withColumn("label", F.concat(F.lit("topic "), "cluster"))
    floor = topics.assignment_floor(own(t)).select("floor").scalar()
    rows = topics.assign(t.embeddings.select("vec_id", "embedding"), model, "embedding", floor)
    return rounded(rows.drop("embedding"), "confidence")


@query(
    "tp_report",
    f"""WITH {OWN} SELECT label AS cluster, count(*) AS size, round(avg(similarity), 6) AS mean_similarity,
       'topic ' || label AS label FROM own GROUP BY own.label""",
)
def tp_report(t):
    labels = centroid_table(t).select("cluster", F.concat(F.lit("topic "), "cluster").alias("label"))
    return rounded(topics.topic_report(own(t), "label", labels), "mean_similarity")


@query(
    "top_terms",
    f"""WITH {duck.counts('tf', 'documents', 'doc_id', 'text', False)},
{duck.idf('terms', 'tf', 'documents', min_df=3, max_features=5000)},
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN terms USING (term)),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
size AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
cs AS (SELECT lang, term, sum(w) AS w FROM w JOIN documents USING (doc_id) GROUP BY lang, term),
al AS (SELECT term, sum(w) AS w FROM cs GROUP BY term),
li AS (SELECT cs.lang AS cluster, cs.term,
              round(cs.w / size.n - al.w / (SELECT count(*) FROM documents), 12) AS lift
       FROM cs JOIN al USING (term) JOIN size USING (lang)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, term) AS INT) AS rank FROM li)
SELECT cluster, rank, term, round(lift, 6) AS lift FROM r WHERE rank <= 6""",
)
def top_terms(t):
    rows = topics.top_terms(t.documents, "lang", "doc_id", "text")
    return rounded(rows, "lift")
