"""Topic clusters over unit-length embeddings."""

from __future__ import annotations

import os
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import fixed
from triagelake.operators import features, kmeans
from triagelake.operators.ranks import quantiles
from triagelake.operators.rows import settle
from triagelake.session import checkpoint


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Scale a vector column to unit length; a zero vector stays zero."""
    df = settle(df, _n=F.sqrt(dot(F.col(vector), F.col(vector))))
    return df.withColumn(vector, F.transform(vector, lambda v: F.coalesce(F.try_divide(v, F.col("_n")), F.lit(0.0)))).drop("_n")


def cluster_sums(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``(cluster, n, s)``: size and vector sum, combined before the shuffle."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col(vector).cast("array<double>"))))
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n"), total.alias("s")
    )


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``(cluster, n, centroid)``: cluster means scaled to unit length."""
    means = cluster_sums(df, cluster, vector).withColumn(
        "centroid", F.transform("s", lambda v: v / F.col("n"))
    )
    return unit(means, "centroid").select("cluster", "n", "centroid")


def silhouette(df: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """Cosine silhouette per row, exact and linear in the rows.

    For unit vectors the mean distance to a cluster is ``1 - x.S/n`` with S
    the cluster's vector sum, so no pair of rows is compared.
    """
    rows = unit(
        df.select(key, F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("x")),
        "x",
    )
    # One entry per cluster.
    sums = cluster_sums(rows, "cluster", "x").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "n", "s")))
    ).scalar()
    near = F.transform(
        "_sums",
        lambda c: F.struct(c["cluster"].alias("cluster"), c["n"].alias("n"),
                           dot(F.col("x"), c["s"]).alias("d")),
    )
    rows = settle(rows.withColumn("_sums", sums), _near=near).drop("_sums")
    own = F.get(F.filter("_near", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    others = F.filter("_near", lambda c: c["cluster"] != F.col("cluster"))
    rows = settle(
        rows,
        _own=own,
        b=F.array_min(F.transform(others, lambda c: 1 - c["d"] / c["n"])),
    )
    a = 1 - F.try_divide(F.col("_own.d") - 1, F.col("_own.n") - 1)
    rows = rows.withColumn("a", a)
    score = F.when(F.col("_own.n") < 2, F.lit(0.0)).otherwise(
        F.coalesce(
            F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
        )
    )
    return rows.select(key, "cluster", score.alias("silhouette"))


def choose_k(
    df: DataFrame,
    vector: str,
    key: str,
    ks=fixed.TOPIC_K_RANGE,
    restarts: int = fixed.TOPIC_RESTARTS,
    seed: int = fixed.SEED,
    parallelism: int = 4,
    max_iter: int = fixed.TOPIC_MAX_ITER,
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """k-means per k with restarts; silhouette of the best run of each k.

    All runs are fitted in the same passes over the rows.  Returns the report
    ``(k, cost, silhouette, best)``, the best run's centres, and the rows with
    their ``cluster``.
    """
    spark = df.sparkSession
    # A piece for every core, as the passes are bound by CPU.
    tasks = max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    points = df.select(
        key, vector, F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("x")
    ).repartition(tasks).persist()
    jobs = [k for k in ks for _ in range(restarts)]
    runs = kmeans.fit(points, jobs, seed, max_iter)
    best_runs = [min((x for j, x in zip(jobs, runs) if j == k), key=lambda x: x[1]) for k in ks]
    rows = checkpoint(kmeans.assigned(points, [c for c, _ in best_runs], [key, vector]))
    points.unpersist()
    own = lambda i: rows.select(key, vector, F.get("clusters", F.lit(i)).alias("cluster"))

    def score(i):
        return float(silhouette(own(i), "cluster", vector, key).agg(F.avg("silhouette")).first()[0])

    with ThreadPool(parallelism) as pool:
        scores = pool.map(score, range(len(best_runs)), chunksize=1)
    best = max(range(len(best_runs)), key=lambda i: (scores[i], -ks[i]))
    report = spark.createDataFrame(
        [(k, cost, s, i == best) for i, (k, (_, cost), s) in enumerate(zip(ks, best_runs, scores))],
        "k int, cost double, silhouette double, best boolean",
    )
    return report, best_runs[best][0], own(best)


def top_terms(
    docs: DataFrame,
    cluster: str,
    key: str,
    column: str,
    limit: int = fixed.TOPIC_TERMS,
    min_df: int = 3,
    max_features: int = 5000,
) -> DataFrame:
    """Terms a cluster uses more than the corpus: mean weight in the
    cluster minus mean weight overall."""
    vectors, _ = features.tfidf(
        docs, key, column, (1, 1), min_df, max_features, sublinear=False
    )
    rows = features.long_weights(vectors, key).join(
        docs.select(key, F.col(cluster).alias("cluster")), key
    )
    # At most max_features rows per cluster from here on.
    sums = rows.groupBy("cluster", "term").agg(F.sum("weight").alias("w"))
    overall = sums.groupBy("term").agg(F.sum("w").alias("all_w"))
    sizes = docs.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    clusters = sizes.select("cluster", "n")
    lift = F.round(F.col("w") / F.col("n") - F.col("all_w") / total, 12)
    scored = sums.join(overall, "term").join(clusters, "cluster").select(
        "cluster", "term", lift.alias("lift")
    )
    best = Window.partitionBy("cluster").orderBy(F.desc("lift"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def topic_labels(terms: DataFrame, limit: int = fixed.TOPIC_LABEL_TERMS) -> DataFrame:
    """``(cluster, label)`` from the first terms of each cluster."""
    few = terms.where(F.col("rank") <= limit)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return few.groupBy("cluster").agg(
        F.array_join(F.transform(ordered, lambda t: t["term"]), ", ").alias("label")
    )


def assign(
    df: DataFrame,
    model: DataFrame,
    vector: str,
    floor: Column | float = 0.0,
) -> DataFrame:
    """Nearest centroid, its similarity, and whether it is below ``floor``.

    ``model`` has ``cluster`` and ``centroid``, and may have ``label``; it
    holds one row per topic and travels as one constant.
    """
    known = model.withColumn("label", F.col("label") if "label" in model.columns else F.lit(""))
    table = known.agg(
        F.sort_array(F.collect_list(F.struct("cluster", "centroid", "label")))
    ).scalar()
    x = F.col(vector).cast("array<double>")
    near = F.transform(
        "_model",
        lambda c: F.struct(
            F.round(dot(F.col("_x"), c["centroid"]), 12).alias("confidence"),
            (-c["cluster"]).alias("order"),
            c["cluster"].alias("cluster"),
            c["label"].alias("label"),
        ),
    )
    rows = settle(df.withColumn("_x", x).withColumn("_model", table), _best=F.array_max(near))
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    return rows.withColumns(
        {
            "label": F.col("_best.label"),
            "cluster": F.col("_best.cluster"),
            "confidence": F.col("_best.confidence"),
            "uncertain": F.coalesce(F.col("_best.confidence") < floor, F.lit(True)),
            "error": F.when(F.col("_best").isNull(), F.lit("topic model unavailable")),
        }
    ).drop("_x", "_model", "_best")


def own_similarity(df: DataFrame, model: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Add ``similarity`` to the own cluster's centroid."""
    known = model.select(F.col("cluster").alias(cluster), "centroid")
    joined = df.join(known, cluster)
    return joined.withColumn(
        "similarity", dot(F.col(vector).cast("array<double>"), F.col("centroid"))
    ).drop("centroid")


def assignment_floor(rows: DataFrame) -> DataFrame:
    """10th percentile and median of the similarity to the own centroid."""
    return quantiles(rows, "similarity", {"floor": 0.1, "median": 0.5})


def topic_report(rows: DataFrame, cluster: str, labels: DataFrame) -> DataFrame:
    sizes = rows.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), F.avg("similarity").alias("mean_similarity")
    )
    return sizes.join(labels, "cluster", "left")


def save_topics(model: DataFrame, floor: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(os.path.join(path, "centroids"))
    floor.write.mode("overwrite").parquet(os.path.join(path, "floor"))


def load_topics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.parquet(os.path.join(path, "centroids")),
        spark.read.parquet(os.path.join(path, "floor")),
    )
