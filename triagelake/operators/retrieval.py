"""Retrieval corpus, hits, index files and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import fixed, text
from triagelake.operators import features, filters, postings, search, split
from triagelake.operators.ranks import quantiles
from triagelake.session import checkpoint, discard


def build_corpus(
    tickets: DataFrame,
    quality: DataFrame,
    order_key: str,
    min_content: int = fixed.MIN_CONTENT_WORDS,
    max_words: int = fixed.MAX_WORDS,
) -> DataFrame:
    """Retrievable tickets with usable content, one per description.

    ``resolution`` becomes the filtered text; ``text`` is the capped
    description to index.  ``order_key`` decides which copy is first.
    """
    content = quality.where(F.col("content_words") >= min_content).select(
        "ticket_id", "resolution_content", "content_words"
    )
    rows = tickets.where("retrievable").join(content, "ticket_id", "inner")
    rows = rows.withColumn("resolution", F.col("resolution_content"))
    rows = filters.keep_first_text(rows, "description", order_key)
    return rows.withColumn("text", text.first_words(F.col("description"), max_words))


def sparse_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = fixed.TOP_K,
    ngrams: tuple[int, int] = (1, 2),
    exclude_self: bool = False,
    **options,
) -> DataFrame:
    """TF-IDF search.  ``queries (query_id, text)``, ``corpus (corpus_id,
    text)``; the vocabulary is fitted on the corpus alone."""
    counts = postings.numbered_counts(queries, "query_id", "text", ngrams, "qid")
    asked = features.asked_terms(counts)
    index = postings.build(corpus, ngrams, asked)
    discard(asked)
    hits = postings.top_k(counts, index, k, exclude_self, **options)
    for used in (counts, index["postings"], index["vectors"]):
        discard(used)
    return hits


def dense_search(
    queries: DataFrame, corpus: DataFrame, k: int = fixed.TOP_K, **options
) -> DataFrame:
    """Search over unit-length embeddings in the column ``vector``."""
    return search.top_k(queries, corpus, k, **options)


def mark_weak(hits: DataFrame, floor: float = fixed.SIMILARITY_FLOOR) -> DataFrame:
    return hits.withColumn("weak", F.col("similarity") < floor)


def with_payload(hits: DataFrame, corpus: DataFrame, shown=fixed.HIT_PAYLOAD) -> DataFrame:
    """Add what is ``shown`` of each hit."""
    return mark_weak(hits).join(corpus.select("corpus_id", *shown), "corpus_id")


# --- index files -------------------------------------------------------------

def save_index(corpus: DataFrame, path: str, ngrams: tuple[int, int] = (1, 2)) -> None:
    """Write postings, vocabulary and weights, so scoring never refits."""
    postings.save(postings.build(corpus, ngrams), path)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return postings.load(spark, path)


def search_index(
    queries: DataFrame,
    index: dict[str, DataFrame],
    k: int = fixed.TOP_K,
    ngrams: tuple[int, int] = (1, 2),
    **options,
) -> DataFrame:
    """Search a saved index."""
    counts = postings.numbered_counts(queries, "query_id", "text", ngrams, "qid")
    hits = postings.top_k(counts, index, k, **options)
    discard(counts)
    return hits


# --- evaluation --------------------------------------------------------------

def self_retrieval_hits(
    docs: DataFrame, key: str, column: str, k: int = 10, ngrams: tuple[int, int] = (1, 2)
) -> tuple[DataFrame, DataFrame]:
    """Second halves indexed, first halves asked: ``(queries, hits)``."""
    halves = checkpoint(split.half_split(docs.select(key, column), column))
    asked = halves.select(F.col(key).alias("query_id"), F.col("query_half").alias("text"))
    corpus = halves.select(F.col(key).alias("corpus_id"), F.col("document_half").alias("text"))
    return asked, sparse_search(asked, corpus, k, ngrams)


def self_retrieval_metrics(
    queries: DataFrame, hits: DataFrame, at=fixed.RECALL_AT
) -> DataFrame:
    """Recall at each k, mean reciprocal rank, scores of correct hits."""
    correct = hits.where("query_id = corpus_id").select("rank", "similarity")
    n = queries.agg(F.count("*")).scalar()
    found = correct.agg(
        *[F.sum((F.col("rank") <= k).cast("long")).alias(f"at_{k}") for k in at],
        F.sum(1.0 / F.col("rank")).alias("reciprocal"),
    )
    spread = quantiles(correct, "similarity", {"median": 0.5, "p10": 0.1})
    rates = found.select(
        n.alias("queries"),
        *[
            F.round(F.coalesce(F.col(f"at_{k}"), F.lit(0)) / n, 6).alias(f"recall_at_{k}")
            for k in at
        ],
        F.round(F.coalesce("reciprocal", F.lit(0.0)) / n, 6).alias("mrr"),
    )
    return rates.withColumns(
        {
            "median_correct_score": F.round(
                F.coalesce(spread.select("median").scalar(), F.lit(0.0)), 6
            ),
            "p10_correct_score": F.round(
                F.coalesce(spread.select("p10").scalar(), F.lit(0.0)), 6
            ),
        }
    )


def noise_floor(top1: DataFrame) -> DataFrame:
    """Best scores of off-topic queries: maximum and mean."""
    return top1.where("rank = 1").agg(
        F.max("similarity").alias("ood_max_score"), F.avg("similarity").alias("ood_mean_score")
    )


def suggested_floor(p10: DataFrame, noise: DataFrame) -> DataFrame:
    """Gap between correct scores and noise; the midpoint when it is open.

    Both inputs are single rows; ``p10`` has ``p10_correct_score``.
    """
    p = p10.select("p10_correct_score").scalar()
    rows = noise.withColumn("p10_correct_score", p)
    gap = F.col("p10_correct_score") - F.col("ood_max_score")
    middle = (F.col("p10_correct_score") + F.col("ood_max_score")) / 2
    return rows.select(
        F.round("ood_max_score", 6).alias("ood_max_score"),
        F.round("ood_mean_score", 6).alias("ood_mean_score"),
        F.round("p10_correct_score", 6).alias("p10_correct_score"),
        F.round(gap, 6).alias("gap"),
        F.when(gap > 0, F.round(middle, 6)).alias("suggested_floor"),
    )
